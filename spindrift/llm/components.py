"""Connected components of a graph of any size, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import storage

#: Rounds grow with the logarithm of a component's size; more than these are an error.
ROUNDS = 100


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """node, label for each node of edges (a long, b long): the smallest node of its component.

    A node points at a smaller one of its component.  In each round it learns the least that its neighbours' pointers
    point at; then both the node and the one it points at turn to that, and pointers are followed one step, so that
    whole trees are hooked and long chains shorten by halves.  Minima are built where the rows lie before they are
    shuffled.  The joins carry two numbers a row; of a node with very many neighbours, or a label of very many nodes, one task
    gets all rows unless adaptive execution splits them, which it does beyond its threshold for skewed
    partitions.  Rounds end when no label changes; if some still do after ROUNDS, it is an error.
    """
    both = storage.keep(edges.select("a", "b").where("a != b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a != b")).distinct(), f"{what}-edges")
    first = F.least("node", "near")
    labels = storage.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", first.alias("label"), first.alias("further")), f"{what}-0")
    for turn in range(1, ROUNDS + 1):
        near = both.join(labels.select("node", "further"), F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("further").alias("near"))
        own = F.struct("node", F.least("label", "further", "near").alias("lower"), F.col("label").alias("old"))
        hooked = F.struct(F.col("label").alias("node"), F.col("near").alias("lower"), F.lit(None).cast("long").alias("old"))
        lower = storage.keep(labels.select("node", "label", "further").join(near, "node").select(F.inline(F.array(own, hooked))).groupBy("node").agg(F.min("lower").alias("label"), F.max("old").alias("old")), f"{what}-{turn}-lower")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        stepped = storage.keep(lower.join(jump, "label", "left").select("node", "old", "label", "further"), f"{what}-{turn}")
        for past in (lower, labels):
            storage.discard(past)
        labels = stepped
        if stepped.where("label != old").isEmpty():
            return labels.select("node", "label")
    raise RuntimeError(f"{what}: labels still change after {ROUNDS} rounds")
