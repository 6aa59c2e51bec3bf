"""Retrieval metrics over many cases at once."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.sources import fs

#: Characters of items that are sought at a time.
MOST_CHARS = 20_000_000


def containing(documents: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, doc_id of documents that hold an item's text exactly.

    The items' texts are one automaton, through which each document is run once; items of more than MOST_CHARS characters
    together are taken in several.
    """
    import ahocorasick

    spark = documents.sparkSession
    wanted = items.where(F.length("text") > 0).select("item_id", "text").distinct()
    size = wanted.agg(F.sum(F.length("text"))).first()[0] or 0
    slices, found = max(1, -(-size // MOST_CHARS)), None
    for part in range(slices):
        some = wanted if slices == 1 else wanted.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == part)
        held: dict[str, list[int]] = {}
        for r in some.orderBy("item_id").toLocalIterator():
            held.setdefault(r["text"], []).append(r["item_id"])
        shared = spark.sparkContext.broadcast(held)

        def run(batches, shared=shared):
            machine = ahocorasick.Automaton()
            for text, ids in shared.value.items():
                machine.add_word(text, ids)
            machine.make_automaton()
            for batch in batches:
                rows = [(i, d) for d, text in zip(batch["doc_id"], batch["text"], strict=True) if text and len(machine) for i in {i for _, ids in machine.iter(text) for i in ids}]
                yield pd.DataFrame(rows, columns=["item_id", "doc_id"])

        hits = documents.select("doc_id", "text").mapInPandas(run, "item_id long, doc_id long").distinct()
        found = hits if found is None else found.unionAll(hits)
    return found


def deduped(ranked: DataFrame, by: str = "path") -> DataFrame:
    """Each of a query's files once, at its first place, with places closed up."""
    first = ranked.groupBy("query_id", by).agg(F.min("rank").alias("first"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first"))).drop("first")


def packed_recall(packed: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, context_recall: the part of a query's gold files whose header lines stand in its packed text."""
    header = F.concat(F.lit("## "), F.col("path"))
    there = F.contains(F.col("output"), F.concat(header, F.lit("\n"))) | F.col("output").endswith(header)
    return gold.join(packed, "query_id").groupBy("query_id").agg(F.avg(F.coalesce(there, F.lit(False)).cast("int")).alias("context_recall"))


def case_metrics(cases: DataFrame, gold: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """item_id, recall, rr, ndcg, hit, first_rank of each case; zeros where there is no gold."""
    hits = ranked.where(F.col("rank") <= k).join(gold, ["item_id", "doc_id"]).groupBy("item_id").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first_rank"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    wanted = gold.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_gold"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_gold", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return cases.join(wanted, "item_id", "left").join(hits, "item_id", "left").select(
        "item_id",
        F.when(F.col("n_gold").isNull(), 0.0).otherwise(F.coalesce("hits", F.lit(0)) / F.col("n_gold")).alias("recall"),
        F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("rr"),
        F.when(F.col("n_gold").isNull(), 0.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
        F.coalesce(F.col("hits") > 0, F.lit(False)).alias("hit"), "first_rank",
    )


def run(search: Callable[[DataFrame], DataFrame], cases: DataFrame, gold: DataFrame, k: int = 10, on_part: Callable[[DataFrame, str | None], None] = lambda cases, error: None) -> DataFrame:
    """case_metrics() of a search function over all cases, with elapsed_ms and error of each.

    search takes cases (item_id, text, ...) and gives item_id, doc_id, rank.  All cases go through it at once; if that fails they are halved
    by their hashes until the cases that fail stand alone, so that n cases of which one fails take some 2 log n searches. A case that
    fails has zeros and its error, and does not stop the others.  elapsed_ms is the search's time shared by the cases that went through it together.
    on_part is told of every group of cases that is through.
    """
    spark = cases.sparkSession
    cases = fs.kept(cases.withColumn("_bits", F.xxhash64("item_id")))
    pending, found, told = [(0, 0)], [], []
    while pending:
        depth, bits = pending.pop()
        part = cases.where(F.col("_bits").bitwiseAND((1 << depth) - 1) == bits)
        n = part.count()
        if not n:
            continue
        own, began = part.drop("_bits"), time.perf_counter()
        try:
            ranked = fs.kept(search(own).select("item_id", "doc_id", "rank"))
            error = None
        except Exception as e:
            error = (str(e).strip() or type(e).__name__).splitlines()[0][:200]
            if n > 1 and depth < 62:
                pending += [(depth + 1, bits), (depth + 1, bits | 1 << depth)]
                continue
        told.append(((1 << depth) - 1, bits, (time.perf_counter() - began) * 1000 / n, error))
        if error is None:
            found.append(ranked)
        on_part(own, error)
    ranked = reduce(DataFrame.unionByName, found) if found else cases.select("item_id", F.lit(0).cast("long").alias("doc_id"), F.lit(0).alias("rank")).limit(0)
    parts = spark.createDataFrame(told, "mask long, bits long, elapsed_ms double, error string")
    # each case lies in one part, whose number is the lower bits of its hash; parts are as many as failures times the depth
    of = cases.select("item_id", "_bits").join(F.broadcast(parts), F.col("_bits").bitwiseAND(F.col("mask")) == F.col("bits")).select("item_id", "elapsed_ms", "error")
    return case_metrics(cases.select("item_id"), gold, ranked, k).join(of, "item_id")


def aggregate(metrics: DataFrame) -> DataFrame:
    """One row: cases, recall, mrr, ndcg, hit_rate; and where the cases tell them context_recall over those that have one, and elapsed_ms over those without an error."""
    more = []
    if "context_recall" in metrics.columns:
        more.append(F.round(F.avg("context_recall"), 6).alias("context_recall"))
    if "elapsed_ms" in metrics.columns:
        more.append(F.round(F.avg(F.when(F.col("error").isNull(), F.col("elapsed_ms"))), 6).alias("elapsed_ms"))
    return metrics.agg(
        F.count(F.lit(1)).alias("cases"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate"), *more
    )


def compare(base: DataFrame, other: DataFrame, epsilon: float = 1e-9) -> DataFrame:
    """item_id, verdict: of cases in both reports by ndcg, then by reciprocal rank; added or removed for those in one."""
    joined = base.select("item_id", F.col("ndcg").alias("n0"), F.col("rr").alias("r0")).join(other.select("item_id", F.col("ndcg").alias("n1"), F.col("rr").alias("r1")), "item_id", "full_outer")
    change = F.when(F.abs(F.col("n1") - F.col("n0")) > epsilon, F.col("n1") - F.col("n0")).when(F.abs(F.col("r1") - F.col("r0")) > epsilon, F.col("r1") - F.col("r0")).otherwise(0.0)
    verdict = F.when(F.col("n0").isNull(), "added").when(F.col("n1").isNull(), "removed").when(change > 0, "improved").when(change < 0, "regressed").otherwise("unchanged")
    return joined.select("item_id", verdict.alias("verdict"))


def compared_totals(base: DataFrame, other: DataFrame) -> DataFrame:
    """report, and aggregate()'s columns, of both reports over the cases that they share."""
    ids = base.select("item_id").join(other.select("item_id"), "item_id")
    one = lambda frame, name: aggregate(frame.join(ids, "item_id", "left_semi")).withColumn("report", F.lit(name))
    return one(base, "base").unionByName(one(other, "other"))


def pass_rate(outcomes: DataFrame) -> DataFrame:
    """One row: tasks, passed, pass_rate of outcomes (ok)."""
    return outcomes.agg(F.count(F.lit(1)).alias("tasks"), F.sum(F.col("ok").cast("int")).cast("long").alias("passed"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("pass_rate"))
