"""What several queries read: the stored index over the documents, and tables that are worked out once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.retrieval import hashing_embedder
from spindrift.operators.store import Store
from spindrift.plans.registry import chunks
from spindrift.sources import fs

MODEL, DIM = "hash", 16
_made: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[str], None]) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made or not fs.exists(spark, _made[key]):
        root = fs.scratch(spark, f"{fs.shared_folder(spark)}/spindrift-{name}-{uuid.uuid4().hex}")
        make(root)
        _made[key] = root
    return _made[key]


def stored(spark: SparkSession, sf_dir: str) -> Store:
    """The documents' index, built by the first query of a session that asks for it."""

    def make(root: str) -> None:
        rows = chunks(spark, sf_dir).where("contents is not null")
        store = Store(spark, root, MODEL, DIM)
        store.add(rows, rows.select("path", F.sha2("contents", 256).alias("hash")), embed=hashing_embedder(DIM))

    return Store(spark, _once(spark, sf_dir, "index", make), MODEL, DIM)


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries of a session share, written by the first."""
    root = _once(spark, sf_dir, name, lambda at: build().write.parquet(at))
    return spark.read.parquet(root)
