"""Vectors of texts that were embedded before, by model, size and hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.sources import fs

CACHED = "hash string, embedding array<float>"
#: Buckets by the hash's first digits; a search of few hashes reads few of them.
DIGITS = 2
#: Hashes' beginnings that are told to the scan at most.
MOST_TOLD = 64


class EmbedCache:
    """Vectors below a folder, inserted where absent and never changed.

    Each put appends files, so writers do not disturb each other; what two of them embed at once stands twice and is read once.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, model: str, dim: int) -> str:
        return f"{self.root}/model={model.replace('/', '_')}/dim={dim}"

    def get(self, model: str, dim: int, hashes: DataFrame) -> DataFrame:
        """hash, embedding of those hashes (hash) that are held, with vectors of the right size."""
        folder = self._folder(model, dim)
        if not fs.exists(self.spark, folder):
            return self.spark.createDataFrame([], CACHED)
        rows = self.spark.read.schema(f"{CACHED}, bucket string").parquet(folder).where(F.size("embedding") == dim)
        asked = hashes.select("hash").distinct()
        told = [r["bucket"] for r in asked.select(F.substring("hash", 1, DIGITS).alias("bucket")).distinct().limit(MOST_TOLD + 1).collect()]
        if len(told) <= MOST_TOLD:
            rows = rows.where(F.col("bucket").isin(told))
        return rows.join(asked, "hash", "left_semi").groupBy("hash").agg(F.first("embedding").alias("embedding"))

    def put(self, model: str, dim: int, rows: DataFrame) -> None:
        """Adds rows (hash, embedding) of hashes that are not held; the vectors of held ones stay."""
        held = self.get(model, dim, rows)
        fresh = rows.select("hash", F.col("embedding").cast("array<float>").alias("embedding")).join(held.select("hash"), "hash", "left_anti").dropDuplicates(["hash"])
        fresh.withColumn("bucket", F.substring("hash", 1, DIGITS)).repartition("bucket").write.partitionBy("bucket").mode("append").parquet(self._folder(model, dim))

    def embedded(self, rows: DataFrame, model: str, dim: int, embed: Callable[[Column], Column]) -> DataFrame:
        """Rows (contents, ...) with their embedding: each distinct text that is not held is embedded once, and put."""
        hashed = fs.kept(rows.withColumn("hash", F.sha2("contents", 256)))
        missing = hashed.join(self.get(model, dim, hashed).select("hash"), "hash", "left_anti").dropDuplicates(["hash"])
        made = fs.kept(missing.select("hash", embed(F.col("contents")).alias("embedding")))
        self.put(model, dim, made)
        return hashed.join(self.get(model, dim, hashed), "hash").drop("hash")
