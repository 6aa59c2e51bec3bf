"""Fusion of ranked lists, boosts, promotion, floors and provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text as X

RRF_K = 60


def fuse(lists: list[DataFrame], weights: list[float | Column], top_k: int) -> DataFrame:
    """query_id, rowid, score, list_scores..., rank: weighted reciprocal-rank fusion of lists (query_id, rowid, rank, score).

    Equal scores keep the order in which rows were first met, list by list.
    """
    tagged = [
        x.select("query_id", "rowid", F.lit(n).alias("list"), F.col("rank"), (F.lit(w) if not isinstance(w, Column) else w).alias("weight"), *[(F.col("score") if n == m else F.lit(None).cast("double")).alias(f"score_{m}") for m in range(len(lists))])
        for n, (x, w) in enumerate(zip(lists, weights, strict=True))
    ]
    return fused_rows(reduce(DataFrame.unionByName, tagged), top_k, [f"score_{m}" for m in range(len(lists))])


def fused_rows(tagged: DataFrame, top_k: int, carried: list[str]) -> DataFrame:
    """Fusion of rows (query_id, rowid, list, rank, weight) of any number of lists; of carried columns the largest value stays."""
    joined = tagged.groupBy("query_id", "rowid").agg(F.sum(F.col("weight") / (RRF_K + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"), *[F.max(c).alias(c) for c in carried])
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.col("first.list"), F.col("first.rank"))
    return joined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).drop("first")


def reranked(rows: DataFrame, score: Column) -> DataFrame:
    """Rows with a new score, ordered by it; equal ones keep their order."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("new_score", 12)), "rank")
    return rows.withColumn("new_score", score).withColumn("new_rank", F.row_number().over(order)).drop("rank", "score").withColumnsRenamed({"new_score": "score", "new_rank": "rank"})


def symbol_boost(symbol: Column, parent: Column, path: Column, contents: Column, signals: Column) -> Column:
    """What a chunk's score is multiplied by for each signal that its symbol, parent, path or beginning holds; 4 at most."""
    s, p, where, head = X.normalize(symbol), X.normalize(parent), X.normalize(path), X.normalize(F.substring(contents, 1, 600))

    def one(x: Column) -> Column:
        by_symbol = F.when(s == x, 1.4).when((s != "") & (F.contains(s, x) | F.contains(x, s)), 0.8).otherwise(0.0)
        return by_symbol + F.when((p != "") & F.contains(p, x), 0.5).otherwise(0.0) + F.when(F.contains(where, x), 0.35).otherwise(0.0) + F.when(F.contains(head, x), 0.15).otherwise(0.0)

    return F.least(F.lit(4.0), F.aggregate(signals, F.lit(1.0), lambda total, x: total + one(x)))


def editor_boost(symbol: Column, parent: Column, path: Column, contents: Column, active: Column, opened: Column, signals: Column) -> Column:
    """What a chunk's score is multiplied by for an active or open file and for context words; 2.5 at most."""
    s, p, head = X.normalize(symbol), X.normalize(parent), X.normalize(F.substring(contents, 1, 1000))
    start = F.lit(1.0) + F.when(path == active, 0.9).when(F.array_contains(opened, path), 0.35).otherwise(0.0)
    add = lambda total, x: total + F.when((s != "") & F.contains(s, x), 0.4).otherwise(0.0) + F.when((p != "") & F.contains(p, x), 0.25).otherwise(0.0) + F.when(F.contains(head, x), 0.12).otherwise(0.0)
    return F.least(F.lit(2.5), F.aggregate(signals, start, add))


def recency(commits: DataFrame, as_of: str, window_days: int = 30) -> DataFrame:
    """path, recency: the largest 1 / (1 + 0.1 * days) over a path's commits within the window."""
    days = (F.unix_micros(F.to_timestamp(F.lit(as_of))) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400_000_000
    return commits.withColumn("days", days).where(F.col("days").between(0, window_days)).groupBy("path").agg(F.max(1 / (1 + 0.1 * F.col("days"))).alias("recency"))


def promoted(rows: DataFrame, names: Column, most: int = 3) -> DataFrame:
    """Lifts the first rows whose symbol is one of the query's names by 0.6 of the top score."""
    order = Window.partitionBy("query_id").orderBy("rank")
    flag = F.array_contains(names, X.normalize(F.col("symbol"))).cast("int")
    marked = rows.withColumn("flag", flag).withColumn("nth", F.sum("flag").over(order)).withColumn("top", F.greatest(F.max("score").over(Window.partitionBy("query_id")), F.lit(0.0001)))
    return reranked(marked, F.col("score") + F.when((F.col("flag") == 1) & (F.col("nth") <= most), F.col("top") * 0.6).otherwise(0.0)).drop("flag", "nth", "top")


def floored(rows: DataFrame, floor: float) -> DataFrame:
    """Drops rows whose relevance (rerank score, else 1 - distance) is below the floor; rows without either stay."""
    if floor <= 0:
        return rows
    relevance = F.coalesce(F.col("rerank_score"), 1 - F.col("distance"))
    return rows.where(relevance.isNull() | (relevance >= floor))
