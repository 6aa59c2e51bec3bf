"""Keeping an index equal to its sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def freshness(known: DataFrame, current: DataFrame) -> DataFrame:
    """path, status (added, changed, removed, same) from two tables of (path, hash)."""
    k, c = known.select("path", F.col("hash").alias("old")), current.select("path", F.col("hash").alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return k.join(c, "path", "full_outer").select("path", status.alias("status"))


def stale(hashed: DataFrame, chunked: DataFrame, scanned: DataFrame) -> DataFrame:
    """Paths in the index that the scan no longer has."""
    return hashed.select("path").union(chunked.select("path")).distinct().join(scanned.select("path"), "path", "left_anti")


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).where("_nth = 1").drop("_nth")


def cache_split(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Each wanted (model, dim, hash) once, with hit: is it in the cache?"""
    keys = ["model", "dim", "hash"]
    return wanted.select(*keys).distinct().join(cache.select(*keys).distinct().withColumn("hit", F.lit(True)), keys, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def without_paths(table: DataFrame, paths: DataFrame) -> DataFrame:
    """A table without the rows of some paths."""
    return table.join(paths.select("path"), "path", "left_anti")


def last_operations(changes: DataFrame, key: str = "path", order: str = "seq") -> DataFrame:
    """The last operation on each key; sums where the rows lie, so it suits streams' micro-batches too."""
    return changes.groupBy(key).agg(F.max_by("op", order).alias("op"), F.max(order).alias(order))
