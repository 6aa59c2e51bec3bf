"""How quality filters interact: what every order of them keeps, removes and loses, from one CUBE over their failure flags.

A filter that is applied before another takes rows that the other would have taken too.  What a set of filters keeps does not
depend on their order, so all orders follow from the survivors of each subset: a CUBE over the flags and the part gives one
row for each choice of flags, and those whose chosen flags are all false are the subset's survivors.  A step of an order is a pair of
subsets that differ by one filter.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm import storage

FILTERS = "ABCDE"
BIT = {name: 1 << k for k, name in enumerate(FILTERS)}
ALL = (1 << len(FILTERS)) - 1
COUNTS = ("docs", "good", "toxic")
WHITE = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> dict[str, Column]:
    """What fails the filters A to D, which look at one text only."""
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * capitals > 10 * F.length(text).cast("long"), "D": text.rlike(r"[#$%&*|]")}


def flagged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, A to E, good, toxic for every row.

    E (a smaller doc_id has the same text) needs the least doc_id of each text: minima are built where rows lie, and rows meet them by
    text and doc_id together, so copies of one text, however many, lie apart.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = storage.keep(
        documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), *[c.alias(k) for k, c in failures(text).items()]),
        "audit-rows",
    )
    least = rows.groupBy("same").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int") == 1).alias("good"), F.max(F.col("toxic").cast("int") == 1).alias("toxic"))
    false = F.lit(False)
    return (
        rows.join(least, ["same", "doc_id"], "left").join(marks, "doc_id", "left")
        .select("part", "A", "B", "C", "D", (F.col("first").isNull() & F.col("doc_id").isNotNull()).alias("E"), F.coalesce("good", false).alias("good"), F.coalesce("toxic", false).alias("toxic"))
    )


def survivors(flags: DataFrame) -> DataFrame:
    """part, subset (bits of the filters applied) and the counts that pass all of them; every subset of every part, zeros included."""
    names = list(FILTERS)
    combinations = flags.groupBy("part", *names).agg(F.count("*").alias("docs"), F.sum(F.col("good").cast("long")).alias("good"), F.sum(F.col("toxic").cast("long")).alias("toxic"))
    chosen = sum((F.when(F.grouping(c) == 0, BIT[c]).otherwise(0) for c in names), F.lit(0))
    cube = combinations.cube("part", *names).agg(*[F.sum(c).alias(c) for c in COUNTS], chosen.alias("subset"), F.grouping("part").alias("over_parts"))
    none_fails = [F.coalesce(F.col(c), F.lit(False)) == F.lit(False) for c in names]
    passing = cube.where(F.col("over_parts") == 0)
    for c in none_fails:
        passing = passing.where(c)
    # a subset that nothing survives has no such row: at most 32 rows of a part are put beside all 32 subsets
    of = F.map_from_entries(F.collect_list(F.struct("subset", F.struct(*COUNTS))))
    return (
        passing.groupBy("part").agg(of.alias("of")).select("part", "of", F.explode(F.sequence(F.lit(0), F.lit(ALL))).alias("subset"))
        .select("part", "subset", *[F.coalesce(F.col("of")[F.col("subset")][c], F.lit(0)).cast("long").alias(c) for c in COUNTS])
    )


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows for each part.

    Failure conditions: A under 100 words; B less than 80 % of the words distinct; C more than 10 % of the code points in A-Z; D holds any of
    #$%&*|; E equal to the text of a smaller doc_id.  A null text is empty (it fails A), a null lang the part of the empty string. Of rows
    that share text and doc_id none fails E for the other's sake; a row without doc_id fails it never and makes none fail.
    Labels repeated for one doc_id count if any of them marks it; null labels do not.  No rows of documents: no
    rows.  Columns other than doc_id, text, lang, and the labels' doc_id, quality and toxic are not read.
    """
    spark = documents.sparkSession
    subsets = survivors(flagged(documents, labels))
    after = subsets.select(F.col("part"), F.col("subset").alias("after"), *[F.col(c).alias(f"{c}_after") for c in COUNTS])
    size = F.bit_count("subset")
    orders = F.element_at(F.array(*[F.lit(factorial(k) * factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS))]), (size + 1).cast("int"))
    added = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(bit).alias("bit")) for name, bit in BIT.items()])).alias("filter")
    pairs = (
        subsets.select("*", added).where(F.col("subset").bitwiseAND(F.col("filter.bit")) == 0).withColumn("after", F.col("subset").bitwiseOR(F.col("filter.bit"))).join(after, ["part", "after"])
        .select(
            "part", "subset", F.col("filter.name").alias("filter"), (F.col("docs") - F.col("docs_after")).alias("removed"), F.col("docs_after").alias("kept"), (F.col("good") - F.col("good_after")).alias("good_lost"),
            (F.col("toxic") - F.col("toxic_after")).alias("toxic_lost"), orders.cast("long").alias("orders"), (F.col("after") == ALL).alias("last"),
        )
    )
    each = pairs.groupBy("part", "filter").agg(F.max(F.when(F.col("subset") == 0, F.col("removed"))).alias("fails"), F.max(F.when(F.col("last"), F.col("removed"))).alias("unique_fails"), F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    # fixed: 120 orders of five steps
    steps = spark.createDataFrame([("".join(p), k + 1, p[k], sum(BIT[x] for x in p[:k])) for p in permutations(FILTERS) for k in range(len(FILTERS))], "filter_order string, step int, filter string, subset int")
    return (
        pairs.join(F.broadcast(steps), ["subset", "filter"]).join(each, ["part", "filter"])
        .select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
    )


#: The same audit in DuckDB's SQL, from every row's failing filters as bits, without a cube.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
least AS (SELECT text, min(doc_id) AS first FROM w GROUP BY text),
marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, (CASE WHEN len(words) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 10 * length(w.text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN w.doc_id > first THEN 16 ELSE 0 END) AS fails,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w JOIN least USING (text) LEFT JOIN marks USING (doc_id)),
c AS (SELECT part, fails, count(*) AS docs, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
o AS (SELECT '' AS so_far, 0 AS bits UNION ALL SELECT so_far || name, bits + bit FROM o, (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(name, bit) WHERE (bits & bit) = 0),
s AS (
  SELECT whole.so_far AS filter_order, step, (SELECT bits FROM o WHERE so_far = whole.so_far[1:step - 1]) AS before, (SELECT bits FROM o WHERE so_far = whole.so_far[1:step]) AS after
  FROM o whole, range(1, 6) r(step) WHERE length(whole.so_far) = 5),
r AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, after - before AS bit,
    coalesce(sum(docs) FILTER ((fails & after) = 0), 0) AS kept, coalesce(sum(docs) FILTER ((fails & before) = 0 AND (fails & (after - before)) > 0), 0) AS removed,
    coalesce(sum(docs) FILTER ((fails & before) > 0 AND (fails & (after - before)) > 0), 0) AS redundant, coalesce(sum(docs) FILTER (fails = after - before), 0) AS unique_fails,
    coalesce(sum(good) FILTER ((fails & before) = 0 AND (fails & (after - before)) > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER ((fails & before) = 0 AND (fails & (after - before)) > 0), 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, before, after)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
