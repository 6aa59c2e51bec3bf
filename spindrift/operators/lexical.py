"""Full-text search over many queries at once."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.sources import fs

K1, B = 1.2, 0.75
#: Weights of (path, symbol, contents) in a row's term frequency.
WEIGHTS = (5.0, 6.0, 1.0)
#: Query words up to this number are put into the plan, so that rows are reduced to them where they are read.
MOST_HEADS = 1000


def phrases(queries: DataFrame) -> DataFrame:
    """query_id, term, words: a term with underscores is a phrase of its words."""
    terms = queries.select("query_id", F.explode(X.query_terms(F.col("text"))).alias("term"))
    return terms.withColumn("words", X.tokens(F.col("term"))).where(F.size("words") > 0)


def occurrences(found: Column, words: Column) -> Column:
    """How often the words stand in a row among the tokens."""
    width = F.size(words)
    starts = F.sequence(F.lit(0), F.size(found) - width)
    hits = F.filter(starts, lambda k: F.slice(found, k + 1, width) == words)
    return F.when(F.size(found) < width, 0).when(width == 1, F.size(F.filter(found, lambda t: t == words[0]))).otherwise(F.size(hits))


def bm25(chunks: DataFrame, queries: DataFrame, top_k: int, weights: tuple[float, ...] = WEIGHTS, columns: tuple[str, ...] = ("path", "symbol", "contents")) -> DataFrame:
    """query_id, rowid, rank, score (higher is better): BM25 with column weights on term frequencies.

    The document length counts all columns; inverse document frequency below or at 0 becomes 1e-6.
    queries may carry path_prefix (LIKE), which narrows the result but not the statistics.  Each
    row's tokens are reduced to the words asked for before anything is shuffled.
    """
    asked = phrases(queries).withColumn("head", F.col("words")[0])
    heads = [r["head"] for r in asked.select("head").distinct().limit(MOST_HEADS + 1).collect()]
    # a generator between the tokens and their uses, so that each text is tokenized once and not once for each use
    tokens = F.explode(F.array(F.struct(*[X.tokens(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns])))
    sized = chunks.select("rowid", "path", tokens.alias("t")).withColumn("n_tokens", sum((F.size(f"t.{c}") for c in columns), F.lit(0)))
    present = F.concat(*[F.col(f"t.{c}") for c in columns])
    if len(heads) <= MOST_HEADS:  # else the join alone sorts them out
        present = F.array_intersect(present, F.array(*map(F.lit, heads)).cast("array<string>"))
    words = sized.withColumn("head", F.explode(F.array_distinct(present)))
    frequency = sum((F.lit(w) * occurrences(F.col(f"t.{c}"), F.col("words")) for c, w in zip(columns, weights, strict=True)), F.lit(0.0))
    # this exchange of short rows serves the counts of rows and the scores alike
    counts = words.join(asked, "head").select("query_id", "term", "rowid", "path", "n_tokens", frequency.alias("tf")).repartition("rowid").where("tf > 0")
    stats = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("mean"))
    spread = counts.groupBy("term").agg(F.countDistinct("rowid").alias("n_rows"))
    weighted = counts.join(spread, "term").join(F.broadcast(stats), F.lit(True))  # stats is one row
    idf = F.log((F.col("n") - F.col("n_rows") + 0.5) / (F.col("n_rows") + 0.5))
    part = F.when(idf > 0, idf).otherwise(1e-6) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_tokens") / F.col("mean")))
    scored = weighted.groupBy("query_id", "rowid", "path").agg(F.sum(part).alias("score"))
    if "path_prefix" in queries.columns:
        scored = scored.join(queries.select("query_id", "path_prefix"), "query_id").where(F.col("path_prefix").isNull() | X.like_prefix(F.col("path"), F.col("path_prefix")))
    return ranked(scored.select("query_id", "rowid", "score"), top_k)


def ranked(scored: DataFrame, top_k: int, by: str = "query_id", ties: str = "rowid") -> DataFrame:
    """The top_k rows of each query by descending score."""
    order = Window.partitionBy(by).orderBy(F.desc(F.round("score", 9)), ties)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def references(chunks: DataFrame, identifier: str, limit: int = 8) -> DataFrame:
    """Rows that hold the identifier as a whole word in its own case, the first by rowid."""
    escaped = "".join("\\" + c if c in r".*+?^${}()|[]\/" else c for c in identifier)
    return chunks.where(F.col("contents").rlike(f"(^|[^A-Za-z0-9_]){escaped}([^A-Za-z0-9_]|$)")).orderBy("rowid").limit(limit)


def _wanted(entries: list[tuple], limit: int) -> list[tuple]:
    """Of entries (key, rowid) those that may be among the first `limit` of an anchor, which leaves its own rowid out."""
    out, times = [], {}
    for e in sorted(entries):
        if (n := times.get(e[1], 0)) < limit:
            times[e[1]] = n + 1
            out.append(e)
            if len(out) == 2 * limit:
                break
    return out


def _swept(limit: int, back: bool, told: dict[int, tuple[str, list[tuple]]] | None):
    """A pass over parts whose rows stand by path and place: held is what an anchor may still want of the chunks passed in its path.

    Without told comes out what each part held of its last path; with it, by part what those before it passed of a path, each anchor's nearest.
    """

    def run(batches):
        part, path, held, rows = None, None, [], []
        for batch in batches:
            for k, p, at, anchored, other, rowid in zip(*(batch[c].to_pylist() for c in ("part", "path", "at", "anchored", "other", "rowid")), strict=True):
                if k != part or p != path:
                    if told is None and k != part:
                        rows += [(part, path, *e) for e in held]
                    before = (told or {}).get(k)
                    held = list(before[1]) if before and before[0] == p and k != part else []
                    part, path = k, p
                if not anchored:
                    key = other if back else -at
                    if len(held) < 2 * limit or (key, rowid) < held[-1]:
                        held = _wanted([*held, (key, rowid)], limit)
                elif told is not None:  # an anchor's place is its start, other its end
                    rows += [(rowid, r, key - other if back else at + key) for key, r in [e for e in held if e[1] != rowid][:limit]]
            if told is not None and rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["anchor", "rowid", "gap"])
                rows = []
        if told is None and part is not None:
            rows += [(part, path, *e) for e in held]
            columns = [*zip(*rows, strict=True)] or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "path", "key", "rowid"])

    return run


def _nearest_on_side(chunks: DataFrame, anchors: DataFrame, limit: int, back: bool) -> DataFrame:
    """anchor, rowid, gap of the nearest chunks that end before an anchor begins, or (back) that do not.

    Chunks and anchors stand in order of path and place over parts of like sizes, so a file of any length is shared by tasks and no pairs
    are made.  Each part tells the next what is held of its last path: 2 * limit rows a part go through the driver.
    """
    whole = lambda c: F.col(c).cast("long")
    rows = chunks.select("path", whole("end_line").alias("at"), F.lit(0).alias("anchored"), whole("start_line").alias("other"), whole("rowid").alias("rowid"))
    rows = rows.unionAll(anchors.select("path", whole("start_line"), F.lit(1), whole("end_line"), whole("rowid"))).dropna()
    # an anchor stands before the chunks that end on its first line going forward, and behind them going back
    keys = [F.asc("path"), F.desc("at") if back else F.asc("at"), F.asc("anchored") if back else F.desc("anchored")]
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())
    cut = fs.kept(rows.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id())).repartition("part").sortWithinPartitions("part", *keys)
    told, path, held = {}, None, []
    of_parts: dict[int, list] = {}
    for r in cut.mapInArrow(_swept(limit, back, None), "part int, path string, key long, rowid long").collect():
        of_parts.setdefault(r["part"], []).append(r)
    for k in range(parts):
        told[k] = (path, held)
        if found := of_parts.get(k):
            held = _wanted([*(held if found[0]["path"] == path else []), *((r["key"], r["rowid"]) for r in found)], limit)
            path = found[0]["path"]
    return cut.mapInArrow(_swept(limit, back, told), "anchor long, rowid long, gap long")


def near(chunks: DataFrame, anchors: DataFrame, limit: int = 4) -> DataFrame:
    """Other chunks of each anchor's file, nearest by lines first (negative gap: overlap); rows without a path, rowid or lines take no part."""
    both = _nearest_on_side(chunks, anchors, limit, False).unionAll(_nearest_on_side(chunks, anchors, limit, True))
    order = Window.partitionBy("anchor").orderBy("gap", "rowid")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def fuzzy_paths(paths: DataFrame, query: str, limit: int = 12) -> DataFrame:
    """path, score: exact file name, then prefix, substring and subsequence of it; shorter paths first."""
    q = query.lower()
    lower = F.lower("path")
    name = F.element_at(F.split(lower, "/"), -1)
    loose = ".*".join("\\" + c if not c.isalnum() else c for c in q)
    kind = F.when(name == q, 0).when(name.startswith(q), 1).when(F.contains(lower, F.lit(q)), 2).when(lower.rlike(loose), 3)
    return paths.withColumn("score", kind * 1000 + F.least(F.lit(999), F.length("path"))).where("score is not null").orderBy("score", "path").limit(limit).select("path", F.col("score").cast("long"))


def references_of(chunks: DataFrame, terms: DataFrame, limit: int = 8) -> DataFrame:
    """term, rowid, path, n: the first rows that hold each term (a run of letters, digits and underscores) as a whole word in its own case.

    Rows are reduced to their distinct words where they are read, and to the terms themselves if these are few enough to be told; they meet by equality.
    """
    told = [r["term"] for r in terms.select("term").distinct().limit(MOST_HEADS + 1).collect()]
    words = F.array_distinct(F.regexp_extract_all("contents", F.lit("[A-Za-z0-9_]+"), F.lit(0)))
    if len(told) <= MOST_HEADS:
        words = F.array_intersect(words, F.array(*map(F.lit, told)).cast("array<string>"))
    found = chunks.select("rowid", "path", F.explode(words).alias("term")).join(terms.select("term").distinct(), "term")
    nth = F.row_number().over(Window.partitionBy("term").orderBy("rowid"))
    return found.withColumn("n", nth).where(F.col("n") <= limit)


def first_of(chunks: DataFrame, wanted: DataFrame, keys: list[str], order: list[str], limit: int = 5) -> DataFrame:
    """The first chunks, by order, of each wanted combination of keys: lookups by symbol, path, or parent and path."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return chunks.join(wanted.select(*keys).distinct(), keys, "left_semi").withColumn("n", nth).where(F.col("n") <= limit)


def hydrated(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (rowid, ...) with their chunks; a rowid that has none is left out."""
    return hits.join(chunks, "rowid")


def listed(paths: DataFrame, folder: str | None = None, pattern: str | None = None) -> DataFrame:
    """Distinct paths below a folder that match a glob pattern, in order."""
    from spindrift.sources.files import glob

    rows = paths.select("path").distinct()
    if folder:
        rows = rows.where(F.col("path").startswith(folder))
    return (rows.where(F.col("path").rlike(glob(pattern))) if pattern else rows).orderBy("path")
