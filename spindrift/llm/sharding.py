"""Sharding by multi-way Karmarkar-Karp differencing.

Groups of equal texts stay whole.  Groups of at least a BINS-th of all bytes (BINS at
most) stand alone; all others are dealt by hash to BINS bins, which are summed where the rows lie.  So the
driver differences at most 2 * BINS weights however many documents there are.
"""

from __future__ import annotations

import heapq
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm import storage

BINS = 8192
#: Parts of each shard in which slots are numbered apart.
STRETCHES = 512


def difference(weights: list[int], parts: int) -> list[int]:
    """The part (0..parts-1) of each weight.

    Each weight begins as a partial partition (weight, 0, ..., 0).  The two with the
    largest spread are combined, the largest sum of one with the smallest of the other, until one is left.
    """
    heap = [(-w, n, (w, *(0,) * (parts - 1)), n, None) for n, w in enumerate(weights)]
    heapq.heapify(heap)
    number = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        sums = [x + y for x, y in zip(a[2], reversed(b[2]), strict=True)]
        order = sorted(range(parts), key=lambda k: (-sums[k], k))
        low = sums[order[-1]]
        heapq.heappush(heap, (low - sums[order[0]], number, tuple(sums[k] for k in order), None, (a, b, order)))
        number += 1
    out = [0] * len(weights)
    stack = [(heap[0], tuple(range(parts)))] if heap else []
    while stack:
        (_, _, _, leaf, made), names = stack.pop()
        if made is None:
            out[leaf] = names[0]
            continue
        a, b, order = made
        for_a: list[int] = [0] * parts
        for place, k in enumerate(order):
            for_a[k] = names[place]
        stack += [(a, tuple(for_a)), (b, tuple(reversed(for_a)))]
    return out


def shard(documents: DataFrame, shards: int = 8, bins: int = BINS) -> DataFrame:
    """doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null), group_key for every row.

    A null text counts as an empty one: size 1, and one group with the empty texts.
    Repeated rows each get a slot; a null doc_id stays null; an empty table gives no
    rows.  Columns other than doc_id and text are not read.

    bins: a group of less than a bins-th of all bytes is differenced within the bin that its hash names, not by itself.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = storage.keep(
        documents.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("group_key"), F.monotonically_increasing_id().alias("row")),
        "shard-rows",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.groupBy("group_key").agg(F.sum("size").alias("weight"))
    heavy = F.col("weight") * bins >= F.lit(total)
    bin_of = F.pmod(F.xxhash64("group_key"), F.lit(bins)).cast("int")
    items = groups.groupBy(F.when(heavy, F.col("group_key")).alias("group_key"), F.when(~heavy, bin_of).alias("bin")).agg(F.sum("weight").alias("weight"))
    found = sorted(items.collect(), key=lambda r: (r["bin"] is None, r["bin"] or 0, r["group_key"] or ""))
    parts = difference([r["weight"] for r in found], shards)
    bins = spark.createDataFrame([(r["bin"], p) for r, p in zip(found, parts, strict=True) if r["bin"] is not None], "bin int, bin_shard int")
    alone = spark.createDataFrame([(r["group_key"], p) for r, p in zip(found, parts, strict=True) if r["bin"] is None], "group_key string, own_shard int")
    placed = (
        rows.withColumn("bin", bin_of).withColumn("stretch", F.pmod(F.xxhash64("row"), F.lit(STRETCHES)).cast("int"))
        .join(F.broadcast(bins), "bin", "left").join(F.broadcast(alone), "group_key", "left")
        .withColumn("shard", F.coalesce("own_shard", "bin_shard"))
    )
    sizes = {(r["shard"], r["stretch"]): r["count"] for r in placed.groupBy("shard", "stretch").count().collect()}
    first = []
    for s in range(shards):
        counts = [sizes.get((s, k), 0) for k in range(STRETCHES)]
        first += [(s, k, n) for k, n in enumerate(accumulate(counts[:-1], initial=0))]
    order = Window.partitionBy("shard", "stretch").orderBy("doc_id", "row")
    return placed.join(F.broadcast(spark.createDataFrame(first, "shard int, stretch int, first long")), ["shard", "stretch"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.row_number().over(order) - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_key"
    )
