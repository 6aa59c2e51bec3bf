"""Exact vector search."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.lexical import ranked


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity as an expression; 0 if a norm is 0."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


#: Query vectors that are sent to every task at a time.
MOST_QUERIES = 4096


def knn(vectors: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """query_id, rowid, rank, distance, score = 1 / (1 + distance): the exact nearest rows by cosine distance.

    The stated queries (query_id, embedding) are held against all rows in blocks: one matrix product for each Arrow batch
    and MOST_QUERIES queries, of which only each
    query's best top_k leave the task.  Where queries have a path_prefix (as LIKE takes it; null: none), only rows (with path) below it are looked at.
    """
    spark = vectors.sparkSession
    prefixed = "path_prefix" in queries.columns
    asked_for = queries.select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>"), (F.col("path_prefix") if prefixed else F.lit(None)).cast("string").alias("path_prefix"))
    slices = max(1, -(-queries.count() // MOST_QUERIES))
    found = None
    for part in range(slices):
        some = asked_for if slices == 1 else asked_for.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == part)
        rows = some.orderBy("query_id").toArrow()
        asked = spark.sparkContext.broadcast((rows["query_id"].to_numpy(), np.array(rows["embedding"].to_pylist(), float).reshape(rows.num_rows, -1), rows["path_prefix"].to_pylist()))
        best = vectors.select("rowid", "embedding", *(["path"] if prefixed else [])).mapInPandas(_best(asked, top_k), "query_id long, rowid long, distance double")
        found = best if found is None else found.unionAll(best)
    return ranked(found.withColumn("score", 1 / (1 + F.round("distance", 9))), top_k)


def _below(prefix: str) -> re.Pattern:
    """The pattern of functions.text.like_prefix for one prefix, over lower-case paths."""
    wild = {"%": ".*", "_": "."}
    return re.compile("".join(wild.get(c, re.escape(c)) for c in prefix.lower()), re.S)


def _best(asked, top_k: int):
    def run(batches):
        ids, wanted, prefixes = asked.value
        norms = np.linalg.norm(wanted, axis=1)
        patterns = {p: _below(p) for p in prefixes if p is not None}
        for batch in batches:
            if not len(batch) or not len(ids):
                continue
            there = np.array(batch["embedding"].tolist(), float)
            both = norms[:, None] * np.linalg.norm(there, axis=1)
            distance = 1 - np.divide(wanted @ there.T, both, out=np.zeros_like(both), where=both > 0)
            rowid = batch["rowid"].to_numpy()
            paths = [p.lower() for p in batch["path"]] if patterns else []
            inside = {p: np.flatnonzero([x.match(path) is not None for path in paths]) for p, x in patterns.items()}
            for q, prefix, row in zip(ids, prefixes, distance, strict=True):
                own = np.arange(len(rowid)) if prefix is None else inside[prefix]
                best = own[np.lexsort((rowid[own], row[own]))[:top_k]]
                yield pd.DataFrame({"query_id": q, "rowid": rowid[best], "distance": row[best]})

    return run


def codec(vector: Column) -> Column:
    """A vector as stored: 32-bit floats."""
    return vector.cast("array<float>")
