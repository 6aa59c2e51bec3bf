"""Registration of queries beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query by its name, with the equivalent SQL where there is one."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of a corpus: rowid, path, symbol (the language), contents."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("rowid"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("symbol"), F.col("text").alias("contents")
    )
