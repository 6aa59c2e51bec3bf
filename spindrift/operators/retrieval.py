"""The whole search, from query texts to ranked and expanded results, for many queries at once."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.functions import text as X
from spindrift.operators import graph, lexical, ranking
from spindrift.operators.store import Store
from spindrift.sources import fs

#: A function from a text column to a vector column, and one from (query, document) columns to a relevance between 0
#: and 1: expressions or pandas UDFs.
Embedder = Callable[[Column], Column]
Reranker = Callable[[Column, Column], Column]
# Rows of a fusion, the least that are reranked, characters of a document that a reranker sees.
CANDIDATES, LEAST_RERANKED, RERANKED_CHARS = 60, 15, 6000
#: What a query's extras without a graph score against the result that they stem from (fixed values).
FACTORS = {"same symbol": 0.65, "same parent": 0.62, "nearby chunk": 0.55, "local import": 0.5, "definition": 0.48, "usage/caller": 0.42}


def hashing_embedder(dim: int = 16) -> Embedder:
    """A deterministic stand-in for a model: how many of a text's words have an MD5 whose first hexadecimal digits, modulo dim, are n."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(tokens: pd.Series) -> pd.Series:
        known: dict[str, int] = {}
        out = []
        for words in tokens:
            vector = np.zeros(dim, np.float32)
            for word in words:
                if (place := known.get(word)) is None:
                    place = known[word] = int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % dim
                vector[place] += 1
            out.append(vector)
        return pd.Series(out)

    return lambda text: embed(X.tokens(F.coalesce(text, F.lit(""))))


def overlap_reranker(query: Column, document: Column) -> Column:
    """A deterministic stand-in for a model: the part of the query's words that a document has."""
    words = F.array_distinct(X.tokens(query))
    return F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.array_intersect(words, X.tokens(document))) / F.size(words))


def document_text(path: Column, symbol: Column, contents: Column) -> Column:
    """What a reranker reads of a chunk: a line that names it, and its beginning."""
    return F.substring(F.concat(F.concat_ws(" ", path, symbol), F.lit("\n"), contents), 1, RERANKED_CHARS)


@dataclass
class Options:
    """What a search is run with; None takes a step out."""

    embed: Embedder | None = None
    rerank: Reranker | None = None
    recency: DataFrame | None = None
    top_k: int = 10
    candidates: int | None = None
    vector_weight: float = 1.0
    bm25_weight: float = 1.0
    recency_weight: float = 0.3
    adaptive: bool = True
    least_score: float = 0.0
    expand: str | None = None
    weights: tuple[float, ...] = lexical.WEIGHTS
    columns: tuple[str, ...] = ("path", "symbol", "contents")
    path_prefix: str | None = None
    on_stage: Callable[[str, DataFrame], None] = field(default=lambda name, frame: None)
    #: Told of a stage that failed, whose search then goes on without it; where it is None, the failure is the search's.
    on_failure: Callable[[str, Exception], None] | None = None


def expanded_text(query: Column) -> Column:
    """A query with the first synonyms of its words, in their order, that it has not already, and the parts of its compound names."""
    table = F.create_map(*[x for word, found in X.synonyms().items() for x in (F.lit(word), F.array(*map(F.lit, found)))])
    tokens = F.regexp_extract_all(query, F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0))
    known = F.transform(tokens, F.lower)
    none = F.array().cast("array<string>")
    added = F.flatten(F.transform(known, lambda w: F.coalesce(F.try_element_at(table, w), none)))
    parts = F.flatten(F.transform(tokens, lambda t: F.filter(F.split(F.lower(X.split_identifier(t)), " "), lambda p: F.length(p) >= 3)))
    fresh = F.filter(F.array_distinct(F.concat(added, parts)), lambda w: ~F.array_contains(known, w))
    return F.when(F.size(fresh) > 0, F.concat_ws(" ", query, F.array_join(fresh, " "))).otherwise(query)


def retrieve(store: Store, queries: DataFrame, options: Options) -> dict[str, DataFrame]:
    """The stages of the search: bm25, vector, fused, reranked, ranked, results (query_id, rowid, rank, score and what each adds), and final.

    queries: query_id, text, and where they are told active_path, open_paths, context_text, path_prefix.  Words are searched as the query has
    them, vectors with its synonyms; a path prefix, of one query or of all (options), narrows both legs alike.  Fused rows are boosted by symbols, editor and recency, reranked and boosted again, and
    for queries that name a symbol its declarations are lifted; then come the floor and the top_k.  A reranker that fails fails the search, unless on_failure is there to be told: then the fused order stays,
    rerank_score is null, and there is no stage reranked.  Each stage is a DataFrame of its own: a consumer may show the first ones while the next are computed.
    """
    if options.path_prefix is not None and "path_prefix" not in queries.columns:
        queries = queries.withColumn("path_prefix", F.lit(options.path_prefix))
    asked, narrowed = queries, [c for c in queries.columns if c == "path_prefix"]
    for name, kind in (("active_path", "string"), ("open_paths", "array<string>"), ("context_text", "string")):
        if name not in asked.columns:
            asked = asked.withColumn(name, F.lit(None).cast(kind))
    asked = asked.withColumn("shape", X.query_shape(F.col("text"))["shape"]).withColumn("signals", X.query_signals(F.col("text"))).withColumn("names", F.transform(X.identifiers(F.col("text")), X.normalize))
    asked = asked.withColumn("context", X.query_signals(F.coalesce("context_text", F.lit("")))).withColumn("opened", F.coalesce("open_paths", F.array().cast("array<string>")))
    wide = options.candidates or (max(4 * options.top_k, 40) if options.top_k else CANDIDATES)
    stages: dict[str, DataFrame] = {}

    def reached(name: str, frame: DataFrame) -> DataFrame:
        stages[name] = frame
        options.on_stage(name, frame)
        return frame

    bm25 = reached("bm25", store.search(queries, wide, options.weights, options.columns))
    legs = [bm25]
    if options.embed is not None and store.has_vectors():
        vectors = asked.select("query_id", options.embed(expanded_text(F.col("text"))).alias("embedding"), *narrowed)
        legs.insert(0, reached("vector", store.nearest(vectors, wide).withColumn("query_id", F.col("query_id").cast(queries.schema["query_id"].dataType))))
    weights = X.fusion_weights(F.col("shape") if options.adaptive else F.lit("none"))
    own = asked.select("query_id", (weights["vector"] if options.adaptive else F.lit(1.0)).alias("w_vector"), (weights["bm25"] if options.adaptive else F.lit(1.0)).alias("w_bm25"))
    told = [F.col("w_vector") * options.vector_weight, F.col("w_bm25") * options.bm25_weight][-len(legs) :]
    fused = ranking.fuse([x.join(own, "query_id") for x in legs], told, options.candidates or CANDIDATES)
    fused = fused.withColumnRenamed("score_0", "vector_score" if len(legs) == 2 else "bm25_score")
    fused = fused.withColumnRenamed("score_1", "bm25_score") if len(legs) == 2 else fused.withColumn("vector_score", F.lit(None).cast("double"))
    if len(legs) == 2:  # the fused row of the vector leg is told by its distance, as the floor needs it
        fused = fused.withColumn("distance", 1 / F.col("vector_score") - 1)
    else:
        fused = fused.withColumn("distance", F.lit(None).cast("double"))
    fused = fs.kept(fused)  # a few rows a query, which all later stages stand on
    columns = ("rowid", "path", "symbol", "parent", "start_line", "end_line", "contents")
    rows = fused.join(store.fetched(fused).select(*columns), "rowid").join(asked.select("query_id", "text", "signals", "context", "active_path", "opened", "shape", "names"), "query_id")
    if options.recency is not None:
        rows = rows.join(options.recency, "path", "left")

    def boosted(frame: DataFrame) -> DataFrame:
        symbol = ranking.symbol_boost(F.col("symbol"), F.col("parent"), F.col("path"), F.col("contents"), F.col("signals"))
        editor = ranking.editor_boost(F.col("symbol"), F.col("parent"), F.col("path"), F.col("contents"), F.col("active_path"), F.col("opened"), F.col("context"))
        out = ranking.reranked(ranking.reranked(frame, F.col("score") * symbol), F.col("score") * editor)
        return out if options.recency is None else ranking.reranked(out, F.col("score") * (1 + options.recency_weight * F.coalesce("recency", F.lit(0.0))))

    ranked = reached("fused", boosted(rows).withColumn("rerank_score", F.lit(None).cast("double")))
    if options.rerank is not None:
        scored = ranked.withColumn("rerank_score", options.rerank(F.col("text"), document_text(F.col("path"), F.col("symbol"), F.col("contents"))))
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rerank_score", 12)), "rank")
        best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(options.top_k, LEAST_RERANKED)).withColumn("score", 1 / F.col("rank"))
        try:  # computed here, so that a reranker that fails does so before results are handed on
            best = fs.kept(best)
        except Exception as e:
            if options.on_failure is None:
                raise
            options.on_failure("reranked", e)
        else:
            ranked = reached("reranked", boosted(best))
    if options.adaptive:
        ranked = ranking.promoted(ranked, F.when(F.col("shape") == "definition", F.col("names")).otherwise(F.array().cast("array<string>")))
    reached("ranked", ranked)
    kept = ranking.floored(ranked, options.least_score)
    order = Window.partitionBy("query_id").orderBy("rank")
    results = reached("results", kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= options.top_k))
    final = results.withColumn("reason", F.lit(None).cast("string"))
    if options.expand is not None:
        results = fs.kept(results)
        extra = fs.kept(graph.expand_chunks(results, store.near) if options.expand == "graph" else symbol_extras(results, store.chunks().select(*columns), references=store.references))
        final = with_extras(results.withColumn("reason", F.lit(None).cast("string")), extra, store.fetched(extra).select(*columns))
    reached("final", final)
    return stages


def with_extras(results: DataFrame, extras: DataFrame, texts: DataFrame) -> DataFrame:
    """Results, and behind them extras (query_id, rowid, place, score, reason) with their chunks."""
    last = results.groupBy("query_id").agg(F.max("rank").alias("last"))
    rows = extras.join(last, "query_id").join(texts, "rowid").withColumn("rank", F.col("last") + F.col("place")).drop("last", "place")
    return results.unionByName(rows, allowMissingColumns=True)


def symbol_extras(results: DataFrame, chunks: DataFrame, top: int = 5, most: int = 12, references: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """query_id, rowid, place, score, reason of chunks that belong to the results, found without a graph.

    For each of the first results in turn: chunks of the same symbol, of the same parent in its file, near it, of files it imports, and the definitions of what it
    names most; then uses of the query's words and the results' symbols.  A chunk's first mention counts, most in all.  references finds uses of terms (term), by a stored index; else the chunks' words are read.
    """
    results = fs.kept(results)
    first = results.where(F.col("rank") <= top).select("query_id", F.col("rank").alias("r"), "rowid", "score", "symbol", "parent", "path", "start_line", "end_line", "contents")
    imported = fs.kept(graph.imported_paths(first.select("query_id", "r", "path", "contents"), chunks.select("path").distinct()).select("query_id", "r", "spec_no", "target"))
    named = fs.kept(first.select("query_id", "r", "score", F.posexplode(X.top_identifiers(F.col("contents"), 6)).alias("at", "name")))
    # one pass over the chunks leaves those that a seed's path, import, symbol or name asks for
    paths = first.select("path").unionAll(imported.select("target")).distinct()
    symbols = first.where("symbol is not null").select("symbol").unionAll(named.select("name")).distinct()
    heads = chunks.select("rowid", "path", "symbol", "parent", "start_line", "end_line")
    asked = heads.join(paths.withColumn("by_path", F.lit(True)), "path", "left").join(symbols.withColumn("by_symbol", F.lit(True)), "symbol", "left").where("by_path or by_symbol")
    # of a symbol that very many chunks bear the first three are enough, unless a path asks for the others
    nth_of_symbol = F.row_number().over(Window.partitionBy("symbol", F.col("by_path").isNull()).orderBy("rowid"))
    c = fs.kept(asked.withColumn("n", nth_of_symbol).where("by_path or n <= 3").drop("n")).select(F.col("rowid").alias("to"), F.col("symbol").alias("c_symbol"), F.col("parent").alias("c_parent"), F.col("path").alias("c_path"), F.col("start_line").alias("c_start"), F.col("end_line").alias("c_end"))

    def nth(frame: DataFrame, by: list[str], order: list, limit: int) -> DataFrame:
        return frame.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("n") <= limit)

    def shaped(frame: DataFrame, group: Column, kind: int, reason: Column, factor: float, sub: Column = F.lit(0)) -> DataFrame:
        return frame.select("query_id", group.cast("int").alias("g"), F.lit(kind).alias("kind"), sub.cast("int").alias("sub"), "n", F.col("to").alias("rowid"), (F.col("score") * factor).alias("score"), reason.alias("reason"))

    r = F.col("r")
    symbols = nth(c.join(first.where("symbol is not null").select("symbol").distinct(), F.col("c_symbol") == F.col("symbol")).select("symbol", "to"), ["symbol"], ["to"], 3)
    same = shaped(first.join(symbols, "symbol"), r, 0, F.concat(F.lit("same symbol: "), "symbol"), FACTORS["same symbol"])
    kin = nth(first.join(c, (F.col("c_parent") == F.col("parent")) & (F.col("c_path") == F.col("path"))), ["query_id", "r"], ["c_start", "to"], 4)
    parents = shaped(kin, r, 1, F.concat(F.lit("same parent: "), "parent"), FACTORS["same parent"])
    gap = F.when(F.col("c_end") < F.col("start_line"), F.col("start_line") - F.col("c_end")).otherwise(F.col("c_start") - F.col("end_line"))
    near = nth(first.join(c, F.col("c_path") == F.col("path")).where("to != rowid"), ["query_id", "r"], [gap, "to"], 3)
    nearby = shaped(near, r, 2, F.lit("nearby chunk"), FACTORS["nearby chunk"])
    of_files = nth(first.join(imported, ["query_id", "r"]).join(c, F.col("c_path") == F.col("target")), ["query_id", "r", "spec_no"], ["c_start", "to"], 2)
    imports = shaped(of_files, r, 3, F.concat(F.lit("local import: "), "target"), FACTORS["local import"], F.col("spec_no"))
    defined = nth(c.where("c_symbol is not null").select(F.col("c_symbol").alias("name"), "to"), ["name"], ["to"], 1)
    definitions = shaped(named.join(defined, "name"), r, 4, F.concat(F.lit("definition: "), "name"), FACTORS["definition"], F.col("at"))
    terms = results.groupBy("query_id").agg(F.first("signals").alias("signals"), F.array_compact(F.transform(F.sort_array(F.collect_list(F.struct("rank", "symbol"))), lambda x: x["symbol"])).alias("symbols"), F.max_by("score", -F.col("rank")).alias("top"))
    terms = fs.kept(terms.select("query_id", (F.greatest("top", F.lit(0.01))).alias("score"), F.posexplode(F.array_distinct(F.slice(F.concat("signals", "symbols"), 1, 12))).alias("at", "term")))
    used = lexical.references_of(chunks, terms.select("term").distinct(), 3) if references is None else references(terms.select("term").distinct(), 3)
    uses = shaped(terms.join(used.select("term", F.col("rowid").alias("to"), "n"), "term"), F.lit(top + 1), 5, F.concat(F.lit("usage/caller: "), "term"), FACTORS["usage/caller"], F.col("at"))
    found = same
    for part in (parents, nearby, imports, definitions, uses):
        found = found.unionByName(part)
    found = found.join(results.select("query_id", "rowid"), ["query_id", "rowid"], "left_anti")
    once = nth(found.withColumn("key", F.struct("g", "kind", "sub", "n")).drop("n"), ["query_id", "rowid"], ["key"], 1).drop("n")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("key"))
    return once.withColumn("place", place).where(F.col("place") <= most).select("query_id", "rowid", "place", "score", "reason")


def debug_items(stage: DataFrame, most: int = 12) -> DataFrame:
    """query_id, rank, path, lines, score, preview of a stage's first rows."""
    preview = F.trim(F.regexp_replace(F.substring("contents", 1, 240), r"\s+", " "))
    return stage.where(F.col("rank") <= most).select("query_id", "rank", "path", F.concat_ws("-", "start_line", "end_line").alias("lines"), F.round("score", 6).alias("score"), preview.alias("preview"))


def summary(final: DataFrame) -> DataFrame:
    """query_id, retrieved, top, graph_added of final results."""
    return final.groupBy("query_id").agg(F.count(F.lit(1)).alias("retrieved"), F.max("score").alias("top"), F.count("reason").alias("graph_added"))


def merged(lists: list[DataFrame], top_k: int) -> DataFrame:
    """The best rows of several repositories' results by their scores as they are."""
    out = lists[0].withColumn("source", F.lit(0))
    for n, x in enumerate(lists[1:], 1):
        out = out.unionByName(x.withColumn("source", F.lit(n)))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "source", "rank")
    return out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_k).drop("rank").withColumnRenamed("place", "rank")


def batches(texts: DataFrame, most_items: int, most_chars: int, by: str = "part") -> DataFrame:
    """Texts (part, pos, text) with the number of the batch that they are embedded in: of at most so many items and characters, a longer text alone.

    A batch begins where the last one is full, so each part's sizes are folded in order.
    """
    sizes = F.transform(F.sort_array(F.collect_list(F.struct("pos", F.length("text").alias("chars")))), lambda x: x)
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("items"), F.lit(0).cast("long").alias("chars"), F.array().cast("array<struct<pos:long,batch:int>>").alias("out"))

    def step(s, x):
        full = (s["items"] > 0) & ((s["items"] >= max(1, most_items)) | (s["chars"] + x["chars"] > max(1, most_chars)))
        batch = s["batch"] + full.cast("int")
        made = F.struct(x["pos"].cast("long").alias("pos"), batch.alias("batch"))
        return F.struct(batch.alias("batch"), (F.when(full, 0).otherwise(s["items"]) + 1).alias("items"), (F.when(full, F.lit(0).cast("long")).otherwise(s["chars"]) + x["chars"]).cast("long").alias("chars"), F.concat(s["out"], F.array(made)).alias("out"))

    folded = texts.groupBy(by).agg(F.aggregate(sizes, start, step)["out"].alias("out"))
    return folded.select(by, F.inline("out"))


class BreakerOpen(RuntimeError):
    """Too many windows failed one after the other."""


def embed_in_windows(files: DataFrame, store_window: Callable[[DataFrame], None], window: int = 48, most_failures: int = 3, is_fatal: Callable[[Exception], bool] = lambda e: False, strict: bool = False) -> DataFrame:
    """path, status, reason after handing files (path, ...) to store_window in windows of so many.

    Files are read once and written by window, and each turn reads its own.  A failed window is noted and left for the next run, since its hashes are not stored; after
    most_failures in a row, or one that is_fatal, no more are tried: the rest is skipped or, if strict, BreakerOpen is raised.
    The loop's turns grow with files / window, so
    a caller with very many files makes windows large; tasks within a window are retried by Spark.
    """
    spark = files.sparkSession
    n = files.count()
    windows = max(1, -(-n // window))
    root = fs.scratch(spark, f"{fs.shared_folder(spark)}/spindrift-windows-{uuid.uuid4().hex}")
    files.withColumn("_window", F.pmod(F.xxhash64("path"), F.lit(windows))).repartition("_window").write.partitionBy("_window").parquet(root)
    placed = spark.read.schema(T.StructType([*files.schema.fields, T.StructField("_window", T.LongType())])).parquet(root)
    rows, failures = [], 0
    for k in range(windows):
        status = ("skipped", "") if failures >= most_failures else ("stored", "")
        if status[0] == "stored":
            try:
                store_window(placed.where(F.col("_window") == k).drop("_window"))
                failures = 0
            except Exception as e:
                failures = most_failures if is_fatal(e) else failures + 1
                status = ("failed", str(e)[:200])
                if strict and failures >= most_failures:
                    raise BreakerOpen(f"window {k + 1} of {windows}: {status[1]}") from e
        rows.append((k, *status))
    told = spark.createDataFrame(rows, "_window long, status string, reason string")
    return placed.select("path", "_window").join(F.broadcast(told), "_window").select("path", "status", F.nullif("reason", F.lit("")).alias("reason"))


def retried(call: Callable, attempts: int = 3, base_ms: float = 200, most_ms: float = 10_000, retry_after: Callable[[Exception], float | None] = lambda e: None, sleep: Callable[[float], None] = time.sleep):
    """Calls until it succeeds, waiting twice as long each time, or what the failure asks for."""
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except Exception as e:
            if attempt == attempts:
                raise
            sleep(max(min(most_ms, base_ms * 2 ** (attempt - 1)), retry_after(e) or 0) / 1000)
