"""The whole search over the stored index: its results, its stages, its extras, and what tells of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.operators import chunking, graph, retrieval
from spindrift.plans import corpus
from spindrift.plans.index import _LINES, files
from spindrift.plans.registry import query, table
from spindrift.plans.search import asked

#: Queries, and what expansion and classification make of them.
ASKED = {1: "src0 the thth_er", 2: "und der die", 3: "get the que list"}
WIDER = {1: "src0 the thth_er thth", 2: "und der die", 3: "get the que list fetch retrieve load"}
SIGNALS = {1: ["src0", "thther", "thth"], 2: ["und", "der", "die"], 3: ["get", "que", "list"]}

_HEX = "0123456789abcdef"


def _digits(tokens: str) -> str:
    """SQL of how many words have each fourth hexadecimal digit in their MD5."""
    return f"list_transform(range(0, 16), lambda n: CAST(len(list_filter({tokens}, lambda x: instr('{_HEX}', md5(x)[4:4]) - 1 = n)) AS DOUBLE))"


def _boost(score: str) -> str:
    return f"""{score} * least(4.0, 1 + list_sum(list_transform(signals, lambda x: (CASE WHEN symbol = x THEN 1.4 WHEN contains(symbol, x) OR contains(x, symbol) THEN 0.8 ELSE 0 END)
 + (CASE WHEN contains(np, x) THEN 0.35 ELSE 0 END) + (CASE WHEN contains(n6, x) THEN 0.15 ELSE 0 END))))"""


_PIPELINE = f"""q AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{v}', '{WIDER[k]}', {SIGNALS[k]}, {0.55 if k == 1 else 1.15}, {1.6 if k == 1 else 0.95})" for k, v in ASKED.items())}) v(query_id, text, wider, signals, w0, w1)),
d AS MATERIALIZED (SELECT doc_id AS rowid, source || '/' || doc_id AS path, lang AS symbol, text AS contents, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents),
terms AS (SELECT query_id, term, string_split(term, '_') AS w FROM (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}'))) AS term FROM q)),
hit AS MATERIALIZED (SELECT * FROM (SELECT query_id, term, rowid, len(t) AS n_tokens, CASE WHEN len(w) = 1 THEN len(list_filter(t, lambda x: x = w[1])) ELSE len(list_filter(range(1, len(t) - len(w) + 2), lambda k: t[k:k + len(w) - 1] = w)) END AS tf FROM d, terms WHERE list_contains(t, w[1])) WHERE tf > 0),
df AS (SELECT term, count(DISTINCT rowid) AS n_rows FROM hit GROUP BY term), s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
scored AS (SELECT query_id, rowid, sum((CASE WHEN ln((n - n_rows + 0.5) / (n_rows + 0.5)) > 0 THEN ln((n - n_rows + 0.5) / (n_rows + 0.5)) ELSE 1e-6 END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_tokens / mean))) AS score FROM hit JOIN df USING (term), s GROUP BY ALL),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rowid) AS rank FROM scored) WHERE rank <= 40),
qv AS (SELECT query_id, {_digits("regexp_extract_all(lower(wider), '[\\p{L}\\p{N}]+')")} AS e FROM q), dv AS (SELECT rowid, {_digits("t")} AS e FROM d),
far AS MATERIALIZED (SELECT query_id, rowid, 1 - CASE WHEN list_sum(dv.e) = 0 THEN 0 ELSE list_cosine_similarity(qv.e, dv.e) END AS distance FROM qv, dv),
vector AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(1 / (1 + round(distance, 9)), 9) DESC, rowid) AS rank FROM far) WHERE rank <= 40),
legs AS (SELECT query_id, rowid, rank, 0 AS list, w0 AS w FROM vector JOIN q USING (query_id) UNION ALL SELECT query_id, rowid, rank, 1, w1 FROM bm25 JOIN q USING (query_id)),
rrf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, list, first) AS rank FROM (SELECT query_id, rowid, sum(w / (60 + rank)) AS score, min(list) AS list, min_by(rank, list) AS first FROM legs GROUP BY ALL)) WHERE rank <= 60),
full_rows AS (SELECT r.query_id, r.rowid, r.rank, r.score, d.path, d.symbol, d.contents, d.t, q.signals, q.text, regexp_replace(lower(path), '[^a-z0-9]+', '', 'g') AS np, regexp_replace(lower(contents[1:600]), '[^a-z0-9]+', '', 'g') AS n6 FROM rrf r JOIN d USING (rowid) JOIN q USING (query_id)),
boosted AS MATERIALIZED (SELECT * EXCLUDE (score, rank, b), b AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(b, 12) DESC, rank) AS rank FROM (SELECT *, {_boost("score")} AS b FROM full_rows)),
told AS (SELECT *, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')), regexp_extract_all(lower((path || ' ' || symbol || chr(10) || contents)[1:6000]), '[\\p{{L}}\\p{{N}}]+'))) / len(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS relevance FROM boosted),
again AS (SELECT * EXCLUDE (rank, score), place AS rank, 1.0 / place AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(relevance, 12) DESC, rank) AS place FROM told) WHERE place <= 15),
ranked AS MATERIALIZED (SELECT * EXCLUDE (score, rank, b), b AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(b, 12) DESC, rank) AS rank FROM (SELECT *, {_boost("score")} AS b FROM again)),
results AS (SELECT * FROM (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM ranked WHERE relevance >= 0.5) WHERE rank <= 10)"""


def options(**more) -> retrieval.Options:
    return retrieval.Options(**({"embed": retrieval.hashing_embedder(corpus.DIM), "rerank": retrieval.overlap_reranker, "least_score": 0.5, "weights": (1.0,), "columns": ("contents",)} | more))


def stages(spark, sf_dir, **more):
    return retrieval.retrieve(corpus.stored(spark, sf_dir), asked(spark, ASKED), options(**more))


@query(f"WITH {_PIPELINE} SELECT query_id, rowid, CAST(rank AS INT) AS rank, round(score, 6) AS score, round(relevance, 6) AS relevance FROM results")
def retrieve_full(spark, sf_dir):
    """Both legs, fusion by the query's shape, boosts, reranking, boosts again, promotion, floor and top ten."""
    return stages(spark, sf_dir)["results"].select("query_id", "rowid", "rank", F.round("score", 6).alias("score"), F.round("rerank_score", 6).alias("relevance"))


@query(f"""WITH {_PIPELINE}, shown AS (SELECT 'fused' AS stage, query_id, rank, path, score, contents FROM boosted WHERE rank <= 12 UNION ALL SELECT 'ranked', query_id, rank, path, score, contents FROM ranked WHERE rank <= 12 UNION ALL SELECT 'final', query_id, rank, path, score, contents FROM results WHERE rank <= 12)
SELECT stage, query_id, CAST(rank AS INT) AS rank, path, round(score, 6) AS score, trim(regexp_replace(contents[1:240], '\\s+', ' ', 'g')) AS preview FROM shown""")
def retrieve_debug(spark, sf_dir):
    found = stages(spark, sf_dir)
    items = [retrieval.debug_items(found[name]).withColumn("stage", F.lit(name)) for name in ("fused", "ranked", "final")]
    return items[0].unionByName(items[1]).unionByName(items[2]).select("stage", "query_id", "rank", "path", "score", "preview")


@query(f"WITH {_PIPELINE} " + " UNION ALL ".join(f"SELECT '{stage}' AS stage, query_id, count(*) AS n FROM {cte} GROUP BY query_id" for stage, cte in (("bm25", "bm25"), ("vector", "vector"), ("fused", "boosted"), ("reranked", "again"), ("results", "results"))))
def retrieve_stages(spark, sf_dir):
    """How many rows each stage hands on; a consumer is given each stage as a DataFrame of its own, in this order."""
    seen = []
    found = stages(spark, sf_dir, on_stage=lambda name, frame: seen.append(name))
    assert seen == ["bm25", "vector", "fused", "reranked", "ranked", "results", "final"]
    out = None
    for name in ("bm25", "vector", "fused", "reranked", "results"):
        counts = found[name].groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "query_id", "n")
        out = counts if out is None else out.unionByName(counts)
    return out


@query(f"WITH {_PIPELINE} SELECT query_id, count(*) AS retrieved, round(max(score), 6) AS top, CAST(0 AS BIGINT) AS graph_added FROM results GROUP BY query_id")
def retrieval_summary(spark, sf_dir):
    return retrieval.summary(stages(spark, sf_dir)["final"]).withColumn("top", F.round("top", 6))


_SYNONYMS = "(VALUES " + ", ".join(f"('{w}', {found})" for w, found in X.synonyms().items()) + ") s(word, found)"


@query(f"""WITH q AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{v}')" for k, v in ASKED.items())}) v(query_id, text) UNION ALL SELECT item_id + 1000, text FROM benchmark),
t AS (SELECT query_id, text, lower(tok) AS word, pos FROM (SELECT *, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{2,}}') AS ts FROM q), unnest(ts) WITH ORDINALITY u(tok, pos)),
a AS (SELECT query_id, pos, 0 AS kind, k, found[k] AS added FROM t JOIN {_SYNONYMS} USING (word), range(1, 4) r(k) WHERE k <= len(found) UNION ALL SELECT query_id, pos, 1, k, string_split(word, '_')[k] FROM t, range(1, 9) r(k) WHERE contains(word, '_') AND k <= len(string_split(word, '_')) AND length(string_split(word, '_')[k]) >= 3),
f AS (SELECT query_id, added, min(kind * 1000000 + pos * 100 + k) AS nth FROM a WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.query_id = a.query_id AND t.word = added) GROUP BY ALL)
SELECT q.query_id, CASE WHEN wide IS NULL THEN text ELSE text || ' ' || wide END AS wider FROM q LEFT JOIN (SELECT query_id, string_agg(added, ' ' ORDER BY nth) AS wide FROM f GROUP BY query_id) USING (query_id)""")
def expanded_queries(spark, sf_dir):
    texts = asked(spark, ASKED).select(F.col("query_id").cast("long").alias("query_id"), "text").unionAll(table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000).alias("query_id"), "text"))
    return texts.select("query_id", retrieval.expanded_text(F.col("text")).alias("wider"))


PREFIX = "src1%/"
_PREFIXED = _PIPELINE.replace("JOIN df USING (term), s GROUP BY ALL", f"JOIN df USING (term), s WHERE rowid IN (SELECT rowid FROM d WHERE path LIKE '{PREFIX}%') GROUP BY ALL").replace("FROM qv, dv)", f"FROM qv, dv WHERE rowid IN (SELECT rowid FROM d WHERE path LIKE '{PREFIX}%'))")


@query(f"WITH {_PREFIXED} SELECT query_id, rowid, path, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM results")
def retrieve_prefixed(spark, sf_dir):
    """The whole search below a path prefix, which both legs keep to."""
    return stages(spark, sf_dir, path_prefix=PREFIX)["results"].select("query_id", "rowid", "path", "rank", F.round("score", 6).alias("score"))


_RECENT = _PIPELINE.replace(_boost("score"), _boost("score * (1 + 0.3 * (rowid % 10) / 10.0)"))


@query(f"WITH {_RECENT} SELECT query_id, rowid, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM results")
def retrieve_recent(spark, sf_dir):
    """The whole search with a boost for files of late changes: here the last digit of the doc_id tells how late."""
    recency = files(spark, sf_dir).select("path", (F.col("doc_id") % 10 / 10.0).alias("recency"))
    return stages(spark, sf_dir, recency=recency)["results"].select("query_id", "rowid", "rank", F.round("score", 6).alias("score"))


_CHUNKS = f"""w AS (SELECT path, l, unnest(range(1, greatest(1, CAST(ceil((len(l) - 4) / 3.0) AS INT) * 3 + 1) + 1, 3)) AS s FROM ({_LINES})),
c AS (SELECT CAST(string_split(path, '/')[2] AS BIGINT) * 10000 + s AS rowid, path, doc.lang AS symbol, doc.source AS parent, s AS start_line, least(s + 3, len(l)) AS end_line, array_to_string(l[s:s + 3], chr(10)) AS contents FROM w JOIN documents doc ON doc.source || '/' || doc.doc_id = w.path)"""


def line_chunks(spark, sf_dir):
    """Windows of the documents' lines as chunks; the language stands for the symbol, the source for its parent."""
    rows = files(spark, sf_dir).select("path", "doc_id", F.col("language").alias("symbol"), F.element_at(F.split("path", "/"), 1).alias("parent"))
    cut = chunking.windows(files(spark, sf_dir), 4, 1).join(rows, "path")
    return cut.select((F.col("doc_id") * 10000 + F.col("start_line")).alias("rowid"), "path", "symbol", "parent", "start_line", "end_line", "contents")


_USES = ["token", "sein", "pour"]


@query(f"""WITH {_CHUNKS}, r AS (SELECT * FROM (SELECT (rowid // 10000) % 7 AS query_id, *, row_number() OVER (PARTITION BY (rowid // 10000) % 7 ORDER BY rowid) AS rank FROM c WHERE start_line = 1) WHERE rank <= 8),
f AS (SELECT *, 1.0 / rank AS score FROM r WHERE rank <= 5),
sym AS (SELECT * FROM (SELECT symbol, rowid, row_number() OVER (PARTITION BY symbol ORDER BY rowid) AS n FROM c) WHERE n <= 3),
same AS (SELECT query_id, rank AS g, 0 AS kind, 0 AS sub, n, sym.rowid, score * 0.65 AS score, 'same symbol: ' || f.symbol AS reason FROM f JOIN sym ON sym.symbol = f.symbol),
kin AS (SELECT * FROM (SELECT query_id, rank AS g, 1 AS kind, 0 AS sub, row_number() OVER (PARTITION BY query_id, rank ORDER BY c.start_line, c.rowid) AS n, c.rowid, score * 0.62 AS score, 'same parent: ' || f.parent AS reason FROM f JOIN c ON c.parent = f.parent AND c.path = f.path) WHERE n <= 4),
near AS (SELECT * FROM (SELECT query_id, rank AS g, 2 AS kind, 0 AS sub, row_number() OVER (PARTITION BY query_id, rank ORDER BY CASE WHEN c.end_line < f.start_line THEN f.start_line - c.end_line ELSE c.start_line - f.end_line END, c.rowid) AS n, c.rowid, score * 0.55 AS score, 'nearby chunk' AS reason FROM f JOIN c ON c.path = f.path AND c.rowid <> f.rowid) WHERE n <= 3),
terms AS (SELECT query_id, unnest(list_filter(l, lambda x, i: list_position(l, x) = i)) AS term, generate_subscripts(list_filter(l, lambda x, i: list_position(l, x) = i), 1) - 1 AS place_no FROM (SELECT query_id, list_slice(list_concat({_USES}, list(symbol ORDER BY rank)), 1, 12) AS l FROM r GROUP BY query_id)),
uses AS (SELECT * FROM (SELECT t.query_id, 6 AS g, 5 AS kind, place_no AS sub, row_number() OVER (PARTITION BY t.query_id, term ORDER BY c.rowid) AS n, c.rowid, 1.0 * 0.42 AS score, 'usage/caller: ' || term AS reason FROM terms t JOIN c ON regexp_matches(c.contents, '(^|[^A-Za-z0-9_])' || term || '([^A-Za-z0-9_]|$)')) WHERE n <= 3),
u AS (SELECT * FROM same UNION ALL SELECT * FROM kin UNION ALL SELECT * FROM near UNION ALL SELECT * FROM uses),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, rowid ORDER BY g, kind, sub, n) AS k FROM u WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.query_id = u.query_id AND r.rowid = u.rowid)) WHERE k = 1)
SELECT query_id, rowid, CAST(place AS INT) AS place, round(score, 6) AS score, reason FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g, kind, sub, n) AS place FROM o) WHERE place <= 12""")
def symbol_expansion(spark, sf_dir):
    """Extras without a graph, about the first windows of the documents."""
    rows = line_chunks(spark, sf_dir)
    order = Window.partitionBy("query_id").orderBy("rowid")
    first = rows.where("start_line = 1").withColumn("query_id", F.floor(F.col("rowid") / 10000) % 7).withColumn("rank", F.row_number().over(order)).where("rank <= 8")
    results = first.withColumn("score", 1 / F.col("rank")).withColumn("signals", F.array(*map(F.lit, _USES)))
    return retrieval.symbol_extras(results, rows).withColumn("score", F.round("score", 6))


@query("""WITH r AS (SELECT n_nationkey % 4 AS query_id, n_nationkey AS n, n_regionkey AS region, row_number() OVER (PARTITION BY n_nationkey % 4 ORDER BY n_nationkey) AS rank FROM nation),
f AS (SELECT query_id, region, min(rank) AS rank FROM r WHERE rank <= 5 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM f),
e AS (SELECT query_id, k * 2 AS o, 'r' || region AS node, 0.55 / rank AS score, 'imports r' || region AS reason FROM k UNION ALL SELECT query_id, k * 2 + 1, r_name, 0.55 * 0.55 * 0.5 / rank, 'type of ' || r_name FROM k JOIN region ON r_regionkey = region WHERE k <= 2)
SELECT query_id, node, CAST(row_number() OVER (PARTITION BY query_id ORDER BY o) AS INT) AS place, round(score, 6) AS score, reason FROM e""")
def graph_expand2(spark, sf_dir):
    """Nations lead to their regions, and the first extras on to what regions lead to."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    edges = nation.select(F.col("n_nationkey").alias("id"), named("n", "n_nationkey").alias("source"), named("r", "n_regionkey").alias("target"), F.lit("imports").alias("kind"), F.lit(1.0).alias("confidence")).unionAll(
        region.select(F.col("r_regionkey") + 100, named("r", "r_regionkey"), "r_name", F.lit("type_of"), F.lit(0.5))
    )
    rank = F.row_number().over(Window.partitionBy(F.col("n_nationkey") % 4).orderBy("n_nationkey"))
    ranked = nation.select((F.col("n_nationkey") % 4).alias("query_id"), named("n", "n_nationkey").alias("node"), rank.alias("rank")).withColumn("score", 1 / F.col("rank"))
    return graph.expand(ranked, edges).withColumn("score", F.round("score", 6))


@query("""WITH c AS (SELECT p_partkey AS rowid, p_brand AS path, p_type AS symbol, p_size AS start_line FROM part), ends AS (SELECT DISTINCT p_brand AS path, CASE WHEN p_size % 3 = 0 THEN p_type WHEN p_size % 3 = 1 THEN 'nowhere' END AS symbol FROM part),
named AS (SELECT * FROM (SELECT symbol, path, rowid, row_number() OVER (PARTITION BY symbol ORDER BY rowid) AS n FROM c) WHERE n <= 2), by_path AS (SELECT path, min_by(rowid, CAST(start_line AS BIGINT) * 1000000000 + rowid) AS rowid FROM c GROUP BY path)
SELECT e.path, e.symbol, coalesce((SELECT min(rowid) FROM named n WHERE n.symbol = e.symbol AND n.path = e.path), b.rowid) AS rowid FROM ends e LEFT JOIN by_path b ON b.path = e.path""")
def edge_resolution(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("rowid"), F.col("p_brand").alias("path"), F.col("p_type").alias("symbol"), F.col("p_size").alias("start_line"))
    ends = part.select(F.col("p_brand").alias("path"), F.when(F.col("p_size") % 3 == 0, F.col("p_type")).when(F.col("p_size") % 3 == 1, "nowhere").alias("symbol"))
    return graph.resolved_ends(ends, rows)


_EDGES = """e AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'o' || l_orderkey AS source_path, CAST(NULL AS VARCHAR) AS source_symbol, 'p' || (l_partkey % 200) AS target_path, 's' || (l_suppkey % 40) AS target_symbol, CASE l_linenumber % 4 WHEN 0 THEN 'calls' WHEN 1 THEN 'imports' WHEN 2 THEN 'extends' ELSE 'called_by' END AS kind FROM lineitem)"""


def order_edges(spark, sf_dir):
    """Order lines as edges from orders to parts, of four kinds."""
    kind = F.element_at(F.array(*map(F.lit, ("calls", "imports", "extends", "called_by"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    named = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), named("o", F.col("l_orderkey")).alias("source_path"), F.lit(None).cast("string").alias("source_symbol"), named("p", F.col("l_partkey") % 200).alias("target_path"), named("s", F.col("l_suppkey") % 40).alias("target_symbol"), kind.alias("kind"), F.lit(1.0).alias("confidence"))


@query(f"WITH {_EDGES} SELECT seed, id FROM (SELECT target_symbol AS seed, id, row_number() OVER (PARTITION BY target_symbol ORDER BY id) AS n FROM e WHERE kind IN ('calls', 'called_by')) WHERE n <= 50")
def callers(spark, sf_dir):
    edges = order_edges(spark, sf_dir)
    return graph.callers(edges, edges.select(F.col("target_symbol").alias("symbol")).distinct()).select("seed", "id")


@query(f"WITH {_EDGES} SELECT seed, id FROM (SELECT target_symbol AS seed, id, row_number() OVER (PARTITION BY target_symbol ORDER BY id) AS n FROM e WHERE kind IN ('implements', 'extends')) WHERE n <= 50")
def implementors(spark, sf_dir):
    edges = order_edges(spark, sf_dir)
    return graph.implementors(edges, edges.select(F.col("target_symbol").alias("symbol")).distinct()).select("seed", "id")


@query(f"""WITH {_EDGES}, seeds AS (SELECT DISTINCT target_path AS seed, CASE WHEN length(target_path) = 2 THEN 's' || substring(target_path, 2) END AS symbol FROM e)
SELECT seed, direction, id FROM (SELECT seed, 'in' AS direction, id, row_number() OVER (PARTITION BY seed ORDER BY id) AS n FROM seeds JOIN e ON e.target_path = seed AND (symbol IS NULL OR symbol = target_symbol) WHERE kind IN ('imports', 'extends')) WHERE n <= 50""")
def graph_neighbors_filtered(spark, sf_dir):
    """Edges of files, and of one symbol in some of them, of two kinds."""
    edges = order_edges(spark, sf_dir)
    path = F.col("target_path")
    seeds = edges.select(path.alias("seed"), path.alias("path"), F.when(F.length(path) == 2, F.concat(F.lit("s"), F.substr(path, F.lit(2)))).alias("symbol")).distinct()
    return graph.touching(edges, seeds, ["imports", "extends"]).select("seed", "direction", "id")


@query(f"WITH {_EDGES} SELECT kind, count(*) AS n FROM e WHERE NOT (source_path = 'p7' OR target_path = 'p7') GROUP BY kind")
def edges_without_path(spark, sf_dir):
    """Edges that neither leave nor reach a path, from a store that holds them."""
    def make(root):
        store = corpus.Store(spark, root)
        store.add(spark.createDataFrame([], "path string, contents string, rowid long"), spark.createDataFrame([], "path string, hash string"), edges=order_edges(spark, sf_dir))
        files_of = order_edges(spark, sf_dir).select(F.col("source_path").alias("path")).distinct()
        store.add(spark.createDataFrame([], "path string, contents string, rowid long"), files_of.withColumn("hash", F.lit("h")), edges=order_edges(spark, sf_dir))

    store = corpus.Store(spark, corpus._once(spark, sf_dir, "edges", make))
    return store.remove_edges("p7").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_REASONS = ["imports src/a.ts:Foo", "src/a.ts:Foo calls this", "called by x", "x called by this", "type of T", "local import: src/b.ts", "usage/caller: open", "definition: Foo", "nearby chunk", "same symbol: A", "same parent: B", "odd this", "what: ever", "exports e.ts"]
_PARSED = [("graph", "imports", "src/a.ts:Foo"), ("graph", "called-by", "src/a.ts:Foo"), ("graph", "called-by", "x"), ("graph", "calls", "x"), ("graph", "type-of", "T"), ("graph", "imports", "src/b.ts"), ("graph", "called-by", "open"), ("expansion", "defines", "Foo"), ("expansion", None, None), ("expansion", "defines", "A"), ("expansion", "defines", "B"), ("graph", None, None), ("expansion", None, None), ("graph", "exports", "e.ts")]


@query("SELECT p_partkey, v.via, v.kind, v.label FROM part JOIN (VALUES " + ", ".join("({}, '{}', {}, {})".format(n, via, *("NULL" if x is None else f"'{x}'" for x in (kind, label))) for n, (via, kind, label) in enumerate(_PARSED)) + f") v(n, via, kind, label) ON n = p_partkey % {len(_REASONS)}")
def reason_grammar(spark, sf_dir):
    reason = F.element_at(F.array(*map(F.lit, _REASONS)), (F.col("p_partkey") % len(_REASONS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", X.parsed_reason(reason).alias("r")).select("p_partkey", "r.via", "r.kind", "r.label")


@query("""WITH l AS (SELECT o_custkey % 50 AS query_id, o_orderkey AS rowid, round(o_totalprice, 2) AS score, o_orderkey % 3 AS source, row_number() OVER (PARTITION BY o_custkey % 50, o_orderkey % 3 ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
SELECT query_id, rowid, CAST(place AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, rank) AS place FROM l) WHERE place <= 20""")
def merge_by_score(spark, sf_dir):
    """Three repositories' results by their raw scores."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("query_id"), F.col("o_orderkey").alias("rowid"), F.round("o_totalprice", 2).alias("score"), "o_totalprice")
    order = Window.partitionBy("query_id").orderBy(F.desc("o_totalprice"), "rowid")
    lists = [rows.where(F.col("rowid") % 3 == n).withColumn("rank", F.row_number().over(order)).drop("o_totalprice") for n in range(3)]
    return retrieval.merged(lists, 20).select("query_id", "rowid", "rank")


@query("""WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p, turn, length(text) AS n FROM conversations),
f AS (SELECT conv_id, p, turn, 0 AS batch, 1 AS items, n AS chars FROM t WHERE p = 1 UNION ALL SELECT t.conv_id, t.p, t.turn, f.batch + CASE WHEN f.items >= 3 OR f.chars + t.n > 400 THEN 1 ELSE 0 END, CASE WHEN f.items >= 3 OR f.chars + t.n > 400 THEN 1 ELSE f.items + 1 END, CASE WHEN f.items >= 3 OR f.chars + t.n > 400 THEN t.n ELSE f.chars + t.n END FROM f JOIN t ON t.conv_id = f.conv_id AND t.p = f.p + 1)
SELECT conv_id AS part, turn AS pos, CAST(batch AS INT) AS batch FROM f""")
def embed_batches(spark, sf_dir):
    texts = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("part"), F.col("turn").alias("pos"), "text")
    return retrieval.batches(texts, 3, 400)


@query("SELECT a.vec_id AS query_id, b.vec_id AS rowid, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, sf_dir):
    """Each vector with the next, through the stored form."""
    from spindrift.operators import vectors

    rows = table(spark, sf_dir, "embeddings").select("vec_id", vectors.codec(F.col("embedding")).alias("e"))
    pairs = rows.select(F.col("vec_id").alias("query_id"), F.col("e").alias("a"), (F.col("vec_id") + 1).alias("rowid")).join(rows.select(F.col("vec_id").alias("rowid"), F.col("e").alias("b")), "rowid")
    return pairs.select("query_id", "rowid", F.round(vectors.cosine(F.col("a"), F.col("b")), 6).alias("similarity"))


@query()
def dependency_chunks(spark, sf_dir):
    """First chunks of what the results' files import, to the second hop: document n imports 2n + 1 and 2n + 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"))
    target = F.explode(F.array(F.col("doc_id") * 2 + 1, F.col("doc_id") * 2 + 2))
    edges = docs.select("doc_id", "path", target.alias("to")).select((F.col("doc_id") * 10 + F.col("to") % 2).alias("id"), F.col("path").alias("source_path"), F.concat(F.lit("f"), F.col("to").cast("string")).alias("target_path"), F.lit("imports").alias("kind"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))
    results = docs.withColumn("query_id", F.floor(F.col("doc_id") / 10)).withColumn("rank", rank).where("rank <= 6").withColumn("score", 1 / F.col("rank"))
    return graph.dependency_chunks(results, edges, docs.select(F.col("doc_id").alias("rowid"), "path", F.lit(1).alias("start_line"))).withColumn("score", F.round("score", 9))


@query(f"""WITH g AS (SELECT CASE (event_id % 3) WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END || (event_id % 11) AS path, user_id AS query_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events)
SELECT query_id, path, CAST(row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS INT) AS rank FROM g GROUP BY query_id, path""")
def dedupe_ranked(spark, sf_dir):
    from spindrift.operators import evaluation

    letter = F.element_at(F.array(*map(F.lit, "abc")), (F.col("event_id") % 3 + 1).cast("int"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.concat(letter, (F.col("event_id") % 11).cast("string")).alias("path"), rank.alias("rank"))
    return evaluation.deduped(rows)
