"""Search queries: lexical and vector legs, fusion, boosts, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.operators import evaluation, lexical, ranking, vectors
from spindrift.operators.store import spread
from spindrift.plans import corpus
from spindrift.plans.registry import chunks, query, table

TEXTS = {1: "the and thth_er", 2: "und der die", 3: "ciónes que la", 4: "éreque les"}
SHAPES = ["getUserData", "where is the config loaded?", "how does the auth middleware work", "src/auth.ts loader", "\"make_response\" helper", "Flask Werkzeug", "parse_http_header", "MAX_SIZE limit", "explain routing", "class Response", "sha256 digest", "SessionInterface open", "remove old files"]

_Q = "(VALUES " + ", ".join(f"({k}, '{v}')" for k, v in TEXTS.items()) + ") q(query_id, text)"
_SHAPES = "(VALUES " + ", ".join("({}, '{}')".format(k, v.replace("'", "''")) for k, v in enumerate(SHAPES)) + ") q(query_id, text)"
#: Tokens and statistics of the one-column index, and its BM25 score.
_BM25 = f"""
d AS (SELECT doc_id AS rowid, source || '/' || doc_id AS path, lang, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents),
terms AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(list_slice(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}')), 1, 16)) AS term FROM {_Q})),
p AS (SELECT query_id, term, string_split(term, '_') AS w FROM terms),
tf AS (SELECT query_id, term, rowid, path, len(t) AS n_tokens,
  CASE WHEN len(w) = 1 THEN len(list_filter(t, lambda x: x = w[1])) ELSE len(list_filter(range(1, len(t) - len(w) + 2), lambda k: t[k:k + len(w) - 1] = w)) END AS tf FROM d, p WHERE list_contains(t, w[1])),
hit AS (SELECT * FROM tf WHERE tf > 0),
df AS (SELECT term, count(DISTINCT rowid) AS n_rows FROM hit GROUP BY term),
s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d),
bm25 AS (SELECT query_id, rowid, path, sum((CASE WHEN ln((n - n_rows + 0.5) / (n_rows + 0.5)) > 0 THEN ln((n - n_rows + 0.5) / (n_rows + 0.5)) ELSE 1e-6 END)
  * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_tokens / mean))) AS score FROM hit JOIN df USING (term), s GROUP BY ALL)"""


def asked(spark, texts=TEXTS):
    return spark.createDataFrame([*texts.items()], "query_id int, text string")


def contents_bm25(spark, sf_dir, top_k=20):
    return corpus.stored(spark, sf_dir).search(asked(spark), top_k, (1.0,), ("contents",))


_TOP = "SELECT query_id, rowid, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rowid) AS rank, score FROM bm25"


@query(f"WITH {_BM25} SELECT query_id, rowid, CAST(rank AS INT) AS rank, round(score, 4) AS score FROM ({_TOP}) WHERE rank <= 20")
def bm25_topk(spark, sf_dir):
    return contents_bm25(spark, sf_dir).select("query_id", "rowid", "rank", F.round("score", 4).alias("score"))


_TF = "len(list_filter({c}, lambda x: x = term))"


@query(f"""WITH q AS (SELECT query_id, term FROM (SELECT query_id, unnest(list_slice(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}')), 1, 16)) AS term FROM (VALUES (1, 'src0 en the'), (2, 'fr les des'), (3, 'que 17')) v(query_id, text))),
d AS (SELECT doc_id AS rowid, regexp_extract_all(lower(source || '/' || doc_id), '[\\p{{L}}\\p{{N}}]+') AS a, regexp_extract_all(lower(lang), '[\\p{{L}}\\p{{N}}]+') AS b, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS c FROM documents),
hit AS (SELECT * FROM (SELECT query_id, term, rowid, len(a) + len(b) + len(c) AS n_tokens, 5.0 * {_TF.format(c='a')} + 6.0 * {_TF.format(c='b')} + {_TF.format(c='c')} AS tf FROM d, q) WHERE tf > 0),
df AS (SELECT term, count(DISTINCT rowid) AS n_rows FROM hit GROUP BY term), s AS (SELECT count(*) AS n, avg(len(a) + len(b) + len(c)) AS mean FROM d),
r AS (SELECT query_id, rowid, sum((CASE WHEN ln((n - n_rows + 0.5) / (n_rows + 0.5)) > 0 THEN ln((n - n_rows + 0.5) / (n_rows + 0.5)) ELSE 1e-6 END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_tokens / mean))) AS score FROM hit JOIN df USING (term), s GROUP BY ALL)
SELECT query_id, rowid, CAST(rank AS INT) AS rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rowid) AS rank FROM r) WHERE rank <= 20""")
def bm25_weighted_fields(spark, sf_dir):
    words = {1: "src0 en the", 2: "fr les des", 3: "que 17"}
    return corpus.stored(spark, sf_dir).search(asked(spark, words), 20).select("query_id", "rowid", "rank", F.round("score", 4).alias("score"))


@query(f"""WITH {_BM25} SELECT query_id, rowid, CAST(rank AS INT) AS rank, round(score, 4) AS score FROM
(SELECT query_id, rowid, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rowid) AS rank FROM bm25 WHERE path ILIKE 'SRC1_/%') WHERE rank <= 10""")
def path_prefix_search(spark, sf_dir):
    queries = asked(spark).withColumn("path_prefix", F.lit("SRC1_/"))
    return corpus.stored(spark, sf_dir).search(queries, 10, (1.0,), ("contents",)).select("query_id", "rowid", "rank", F.round("score", 4).alias("score"))


@query("SELECT doc_id AS rowid, source || '/' || doc_id AS path FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z0-9_])token([^A-Za-z0-9_]|$)') ORDER BY doc_id LIMIT 8")
def phrase_reference_search(spark, sf_dir):
    return corpus.stored(spark, sf_dir).references(spark.createDataFrame([("token",)], "term string")).orderBy("rowid").select("rowid", "path")


def probe_vectors(spark, sf_dir):
    """The stated query vectors: those with vec_id below 20."""
    return table(spark, sf_dir, "embeddings").where("vec_id < 20").select(F.col("vec_id").alias("query_id"), "embedding")


def stored_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rowid"), "embedding", F.concat(F.lit("label"), F.col("label").cast("string"), F.lit("/"), F.col("vec_id").cast("string")).alias("path"))


_KNN = """v AS (SELECT vec_id AS rowid, 'label' || label || '/' || vec_id AS path, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
knn AS (SELECT a.rowid AS query_id, b.rowid, 1 - list_cosine_similarity(a.e, b.e) AS distance, row_number() OVER (PARTITION BY a.rowid ORDER BY round(1 - list_cosine_similarity(a.e, b.e), 9), b.rowid) AS rank FROM v a, v b WHERE a.rowid < 20 {where})"""


@query(f"WITH {_KNN.format(where='')} SELECT query_id, rowid, CAST(rank AS INT) AS rank, round(distance, 5) AS distance FROM knn WHERE rank <= 10")
def knn_cosine_topk(spark, sf_dir):
    return vectors.knn(stored_vectors(spark, sf_dir), probe_vectors(spark, sf_dir), 10).select("query_id", "rowid", "rank", F.round("distance", 5).alias("distance"))


_KNN_IN = _KNN.format(where="AND b.path LIKE 'label3/%'")


@query(f"WITH {_KNN_IN} SELECT query_id, rowid, CAST(rank AS INT) AS rank, round(distance, 5) AS distance FROM knn WHERE rank <= 5")
def knn_prefiltered(spark, sf_dir):
    return vectors.knn(stored_vectors(spark, sf_dir), probe_vectors(spark, sf_dir).withColumn("path_prefix", F.lit("label3/")), 5).select("query_id", "rowid", "rank", F.round("distance", 5).alias("distance"))


def both_legs(spark, sf_dir):
    return vectors.knn(stored_vectors(spark, sf_dir), probe_vectors(spark, sf_dir).where("query_id between 1 and 4"), 60).withColumn("query_id", F.col("query_id").cast("int")), contents_bm25(spark, sf_dir, 60)


def fused(spark, sf_dir, top_k=60, weights=(1.0, 1.0)):
    return ranking.fuse([*both_legs(spark, sf_dir)], [*weights], top_k)


_LEGS = f"""{_BM25}, {_KNN.format(where='AND a.rowid BETWEEN 1 AND 4')},
legs AS (SELECT 0 AS list, CAST(query_id AS INT) AS query_id, rowid, rank, 1 / (1 + round(distance, 9)) AS score FROM knn WHERE rank <= 60
UNION ALL SELECT 1, query_id, rowid, rank, score FROM ({_TOP}) WHERE rank <= 60)"""
_FUSED = """fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, list, first_rank) AS rank FROM
(SELECT query_id, rowid, sum(w / (60 + rank)) AS score, min(list) AS list, min_by(rank, list) AS first_rank FROM (SELECT *, {w} AS w FROM legs) GROUP BY query_id, rowid))"""


@query(f"WITH {_LEGS}, {_FUSED.format(w='1.0')} SELECT query_id, rowid, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM fused WHERE rank <= 20")
def rrf_fusion(spark, sf_dir):
    return fused(spark, sf_dir, 20).select("query_id", "rowid", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_LEGS}, {_FUSED.format(w='CASE WHEN query_id = 1 THEN CASE list WHEN 0 THEN 0.55 ELSE 1.6 END ELSE CASE list WHEN 0 THEN 1.15 ELSE 0.95 END END')} SELECT query_id, rowid, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM fused WHERE rank <= 20")
def adaptive_fusion(spark, sf_dir):
    legs = both_legs(spark, sf_dir)
    weights = F.broadcast(asked(spark).select("query_id", X.fusion_weights(X.query_shape(F.col("text"))["shape"]).alias("w")))
    return ranking.fuse([x.join(weights, "query_id") for x in legs], [F.col("w.vector"), F.col("w.bm25")], 20).select("query_id", "rowid", "rank", F.round("score", 6).alias("score"))


def _shape_sql(source: str) -> str:
    return f"""WITH q AS (SELECT * FROM {source}),
t AS (SELECT query_id, text, list_filter(list_transform(regexp_split_to_array(text, '[\\s,;:?!()\\[\\]{{}}]+'), lambda t: regexp_replace(t, '[^A-Za-z0-9_]', '', 'g')), lambda t: length(t) >= 3) AS bare FROM q),
n AS (SELECT *, list_filter(bare, lambda t: regexp_matches(t, '^[A-Za-z]+(_[A-Za-z0-9]+)+$') OR length(regexp_replace(t[2:], '[^A-Z]', '', 'g')) >= 2
  OR (length(regexp_replace(t[2:], '[^A-Z]', '', 'g')) = 1 AND length(t) >= 8) OR (regexp_matches(t, '[0-9]') AND regexp_matches(t, '^[A-Za-z]'))) AS named FROM t),
c AS (SELECT query_id, text, CAST(regexp_matches(text, '["''`][^"''`]+["''`]') AS INT) + CAST(regexp_matches(text, '(?i)[A-Za-z0-9_./-]+\\.(ts|tsx|js|jsx|mjs|cjs|py|go|rs|java|cs|rb|php|kt|swift|c|h|cpp|hpp|json|ya?ml|toml)\\b') AS INT) + len(named) AS strong,
  len(list_filter(bare, lambda t: NOT list_contains(named, t) AND regexp_matches(t, '^[A-Z][a-z]+$'))) AS capitals, CAST(regexp_matches(text, '(?i)\\b(class|function|method|struct|interface|enum|decorator|module|middleware|endpoint|route|handler|schema|config)\\b') AS INT) AS noun FROM n),
w AS (SELECT *, CASE WHEN strong = 0 AND capitals + noun >= 2 AND capitals = 0 AND regexp_matches(text, '(?i)\\b(how|why|what|where|when)\\b|\\?$|\\bexplain|overview of|walk me through\\b') THEN 0 ELSE capitals + noun END AS weak FROM c)
SELECT query_id, CAST(strong AS INT) AS strong, CAST(weak AS INT) AS weak, CASE WHEN strong > 0 OR weak >= 2 THEN 'definition' ELSE 'intent' END AS shape FROM w"""


@query(_shape_sql(f"(SELECT query_id, text FROM {_SHAPES} UNION ALL SELECT 1000 + item_id, text FROM benchmark)"))
def query_shape(spark, sf_dir):
    stated = spark.createDataFrame([*enumerate(SHAPES)], "query_id long, text string")
    texts = stated.unionAll(table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000).alias("query_id"), "text"))
    return texts.select("query_id", X.query_shape(F.col("text")).alias("s")).select("query_id", "s.strong", "s.weak", "s.shape")


_SYNONYMS = "(VALUES " + ", ".join(f"('{w}', {n}, '{s}')" for w, found in X.synonyms().items() for n, s in enumerate(found)) + ") s(word, n, synonym)"


@query(f"""WITH t AS (SELECT query_id, tok, pos FROM (SELECT query_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{2,}}') AS ts FROM (SELECT query_id, text FROM {_SHAPES} UNION ALL SELECT item_id + 1000, text FROM benchmark)), unnest(ts) WITH ORDINALITY AS u(tok, pos))
SELECT DISTINCT t.query_id, synonym FROM t JOIN {_SYNONYMS} ON lower(tok) = word WHERE NOT EXISTS (SELECT 1 FROM t x WHERE x.query_id = t.query_id AND lower(x.tok) = synonym)""")
def query_expansion(spark, sf_dir):
    words = spark.createDataFrame([(w, s) for w, found in X.synonyms().items() for s in found], "word string, synonym string")
    texts = spark.createDataFrame([*enumerate(SHAPES)], "query_id long, text string").unionAll(table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000).alias("query_id"), "text"))
    tokens = texts.select("query_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0))).alias("token")).withColumn("word", F.lower("token"))
    own = tokens.select("query_id", F.col("word").alias("synonym"))
    return tokens.join(F.broadcast(words), "word").select("query_id", "synonym").distinct().join(own, ["query_id", "synonym"], "left_anti")


_STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@query(f"""WITH b AS (SELECT item_id, unnest(list_concat(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{2,}}'), lambda t: NOT list_contains([{_STOPS}], lower(t))), regexp_split_to_array(text, '[\\s./#:_-]+'))) AS t FROM benchmark)
SELECT DISTINCT item_id, regexp_replace(lower(t), '[^a-z0-9]+', '', 'g') AS signal FROM b WHERE length(regexp_replace(lower(t), '[^a-z0-9]+', '', 'g')) >= 3 AND NOT list_contains([{_STOPS}], regexp_replace(lower(t), '[^a-z0-9]+', '', 'g'))""")
def query_signals(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(X.query_signals(F.col("text"))).alias("signal"))


@query(f"""WITH t AS (SELECT doc_id, tok, pos FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{2,}}'), lambda t: NOT list_contains([{_STOPS}], lower(t))) AS ts FROM documents), unnest(ts) WITH ORDINALITY AS u(tok, pos)),
c AS (SELECT doc_id, tok, count(*) AS n, min(pos) AS p FROM t GROUP BY ALL)
SELECT doc_id, tok AS identifier, n AS times, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS rank FROM c) WHERE rank <= 5""")
def identifier_counts(spark, sf_dir):
    counts = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.slice(X.counted_identifiers(F.col("text")), 1, 5)).alias("at", "c"))
    return counts.select("doc_id", "c.identifier", "c.times", (F.col("at") + 1).alias("rank"))


def boosted_rows(spark, sf_dir):
    """The BM25 leg joined late to its chunks, of which only the hits are read in full."""
    return contents_bm25(spark, sf_dir).join(chunks(spark, sf_dir), "rowid")


_HITS = f"""{_BM25}, hits AS (SELECT b.query_id, b.rowid, b.rank, b.score, d.path, d.lang AS symbol, d.lang AS lang, d.text AS contents FROM ({_TOP}) b JOIN d USING (rowid) WHERE b.rank <= 20),
sig AS (SELECT query_id, list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[\\s./#:_-]+'), lambda t: regexp_replace(lower(t), '[^a-z0-9]+', '', 'g')), lambda t: length(t) >= 3 AND NOT list_contains([{_STOPS}], t)))
 AS signals FROM {_Q}),
n AS (SELECT h.*, regexp_replace(lower(path), '[^a-z0-9]+', '', 'g') AS np, regexp_replace(lower(contents[1:600]), '[^a-z0-9]+', '', 'g') AS n6, regexp_replace(lower(contents[1:1000]), '[^a-z0-9]+', '', 'g') AS n10 FROM hits h)"""
_ORDER = "SELECT query_id, rowid, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, rank) AS INT) AS rank, round(s, 4) AS score FROM "


@query(f"""WITH {_HITS}, sig2 AS (SELECT query_id, list_distinct(list_concat(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{2,}}'), lambda t: NOT list_contains([{_STOPS}], lower(t))), lambda t: regexp_replace(lower(t), '[^a-z0-9]+', '', 'g')), signals)) AS signals FROM sig JOIN {_Q} USING (query_id)),
b AS (SELECT n.*, score * least(4.0, 1 + list_sum(list_transform(signals, lambda x: (CASE WHEN symbol = x THEN 1.4 WHEN contains(symbol, x) OR contains(x, symbol) THEN 0.8 ELSE 0 END)
 + (CASE WHEN contains(regexp_replace(lower(lang || path[1:2]), '[^a-z0-9]+', '', 'g'), x) THEN 0.5 ELSE 0 END) + (CASE WHEN contains(np, x) THEN 0.35 ELSE 0 END) + (CASE WHEN contains(n6, x) THEN 0.15 ELSE 0 END)))) AS s FROM n JOIN sig2 USING (query_id)) {_ORDER} b""")
def symbol_boost(spark, sf_dir):
    signals = F.broadcast(asked(spark).select("query_id", X.query_signals(F.col("text")).alias("signals")))
    factor = ranking.symbol_boost(F.col("symbol"), F.concat("symbol", F.substring("path", 1, 2)), F.col("path"), F.col("contents"), F.col("signals"))
    return ranking.reranked(boosted_rows(spark, sf_dir).join(signals, "query_id"), F.col("score") * factor).select("query_id", "rowid", "rank", F.round("score", 4).alias("score"))


@query(f"""WITH {_HITS}, b AS (SELECT *, score * least(2.5, 1 + (CASE WHEN path = 'src0/1' THEN 0.9 WHEN path LIKE 'src0/%' THEN 0.35 ELSE 0 END)
 + (CASE WHEN contains(symbol, 'the') THEN 0.4 ELSE 0 END) + (CASE WHEN contains(n10, 'the') THEN 0.12 ELSE 0 END) + (CASE WHEN contains(n10, 'ing') THEN 0.12 ELSE 0 END)) AS s FROM n) {_ORDER} b""")
def editor_boost(spark, sf_dir):
    rows = boosted_rows(spark, sf_dir)
    opened = F.when(F.col("path").startswith("src0/"), F.array("path")).otherwise(F.array().cast("array<string>"))
    factor = ranking.editor_boost(F.col("symbol"), F.lit(None).cast("string"), F.col("path"), F.col("contents"), F.lit("src0/1"), opened, F.array(F.lit("the"), F.lit("ing")))
    return ranking.reranked(rows, F.col("score") * factor).select("query_id", "rowid", "rank", F.round("score", 4).alias("score"))


@query(f"""WITH {_HITS}, days AS (SELECT user_id, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400000000.0 AS d FROM events),
r AS (SELECT user_id, max(1 / (1 + 0.1 * d)) AS recency FROM days WHERE d BETWEEN 0 AND 30 GROUP BY user_id),
b AS (SELECT n.*, score * (1 + 0.3 * coalesce(recency, 0)) AS s FROM n LEFT JOIN r ON r.user_id = n.rowid) {_ORDER} b""")
def recency_boost(spark, sf_dir):
    commits = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), "ts")
    recent = ranking.recency(commits, "2024-01-31 00:00:00").withColumnRenamed("path", "rowid")
    rows = boosted_rows(spark, sf_dir).join(recent, "rowid", "left")
    return ranking.reranked(rows, F.col("score") * (1 + 0.3 * F.coalesce("recency", F.lit(0.0)))).select("query_id", "rowid", "rank", F.round("score", 4).alias("score"))


@query(f"""WITH {_HITS}, f AS (SELECT *, CAST(symbol IN ('en', 'fr') AS INT) AS flag, greatest(max(score) OVER (PARTITION BY query_id), 0.0001) AS top FROM n),
g AS (SELECT *, sum(flag) OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM f), b AS (SELECT *, score + CASE WHEN flag = 1 AND nth <= 3 THEN top * 0.6 ELSE 0 END AS s FROM g) {_ORDER} b""")
def declaration_promotion(spark, sf_dir):
    return ranking.promoted(boosted_rows(spark, sf_dir), F.array(F.lit("en"), F.lit("fr"))).select("query_id", "rowid", "rank", F.round("score", 4).alias("score"))


@query(f"WITH {_KNN.format(where='')} SELECT query_id, rowid, CAST(rank AS INT) AS rank FROM knn WHERE rank <= 200 AND CASE WHEN rowid % 3 = 0 THEN (rowid % 10) / 10.0 WHEN rowid % 3 = 1 THEN 1 - distance ELSE 1 END >= 0.3")
def min_score_floor(spark, sf_dir):
    """Rows with a reranker's score, with a distance only, and with neither."""
    rows = vectors.knn(stored_vectors(spark, sf_dir), probe_vectors(spark, sf_dir), 200)
    third = F.col("rowid") % 3
    rows = rows.withColumn("rerank_score", F.when(third == 0, F.col("rowid") % 10 / 10)).withColumn("distance", F.when(third < 2, F.col("distance")))
    return ranking.floored(rows, 0.3).select("query_id", "rowid", "rank")


@query(f"""WITH {_BM25}, w AS (SELECT b.query_id, b.rowid, d.lang AS ws, row_number() OVER (PARTITION BY b.query_id, d.lang ORDER BY round(score, 9) DESC, b.rowid) AS rank FROM bm25 b JOIN d USING (rowid)),
f AS (SELECT *, 1.0 / (60 + rank) AS s, CASE ws WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END AS list FROM w WHERE rank <= 15 AND ws IN ('en', 'de', 'fr', 'es'))
SELECT query_id, rowid, CAST(rank AS INT) AS rank, round(s, 6) AS score FROM (SELECT query_id, rowid, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, list, rank) AS rank FROM f) WHERE rank <= 15""")
def multi_workspace_rrf(spark, sf_dir):
    """Each language is a workspace with a list of its own; one pass of the index's postings ranks them all."""
    store = corpus.stored(spark, sf_dir)
    scored = store.scores(asked(spark), (1.0,), ("contents",)).join(store.chunks().select("rowid", "symbol"), "rowid").where(F.col("symbol").isin("en", "de", "fr", "es"))
    order = Window.partitionBy("query_id", "symbol").orderBy(F.desc(F.round("score", 9)), "rowid")
    number = F.when(F.col("symbol") == "en", 0).when(F.col("symbol") == "de", 1).when(F.col("symbol") == "fr", 2).otherwise(3)
    lists = scored.withColumn("rank", F.row_number().over(order)).where("rank <= 15").select("query_id", "rowid", "rank", number.alias("list"), F.lit(1.0).alias("weight"))
    return ranking.fused_rows(lists, 15, []).select("query_id", "rowid", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {_LEGS}, {_FUSED.format(w='1.0')} SELECT f.query_id, f.rowid, CASE WHEN a.rowid IS NOT NULL AND b.rowid IS NOT NULL THEN 'hybrid' WHEN a.rowid IS NOT NULL THEN 'vector' ELSE 'bm25' END AS via
FROM fused f LEFT JOIN (SELECT * FROM legs WHERE list = 0) a ON a.query_id = f.query_id AND a.rowid = f.rowid LEFT JOIN (SELECT * FROM legs WHERE list = 1) b ON b.query_id = f.query_id AND b.rowid = f.rowid WHERE f.rank <= 20""")
def provenance_via(spark, sf_dir):
    via = F.when(F.col("score_0").isNotNull() & F.col("score_1").isNotNull(), "hybrid").when(F.col("score_0").isNotNull(), "vector").otherwise("bm25")
    return fused(spark, sf_dir, 20).select("query_id", "rowid", via.alias("via"))


#: A deterministic ranking to be judged: each item's gold and the 30 documents that follow it by number.
_RANKED = """g AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
c AS (SELECT item_id, doc_id, 0 AS o FROM g WHERE (item_id + doc_id) % 3 <> 0 UNION ALL SELECT item_id, doc_id, 1 FROM benchmark JOIN documents ON doc_id BETWEEN item_id * 7 AND item_id * 7 + 30),
u AS (SELECT item_id, doc_id, min(o) AS o FROM c GROUP BY ALL),
k AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY (doc_id * 31 + item_id) % 97, doc_id) AS rank FROM u),
m AS (SELECT b.item_id, coalesce(n, 0) AS n_gold, coalesce(hits, 0) AS hits, first, coalesce(dcg, 0) AS dcg FROM benchmark b LEFT JOIN (SELECT item_id, count(*) AS n FROM g GROUP BY ALL) USING (item_id)
 LEFT JOIN (SELECT item_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM k JOIN g USING (item_id, doc_id) WHERE rank <= 10 GROUP BY ALL) USING (item_id)),
e AS (SELECT item_id, CASE WHEN n_gold = 0 THEN 0.0 ELSE hits / n_gold END AS recall, coalesce(1.0 / first, 0.0) AS rr, CASE WHEN n_gold = 0 THEN 0.0 ELSE dcg / list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda i: 1 / log2(i + 1))) END AS ndcg, hits > 0 AS hit, CAST(first AS INT) AS first_rank FROM m)"""


def gold_of(spark, sf_dir):
    """item_id, doc_id: documents that hold an item's text."""
    return corpus.once(spark, sf_dir, "gold", lambda: evaluation.containing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def judged(spark, sf_dir):
    gold = gold_of(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select("item_id")
    documents = table(spark, sf_dir, "documents").select("doc_id")
    near = items.select("item_id", F.explode(F.sequence(F.col("item_id") * 7, F.col("item_id") * 7 + 30)).alias("doc_id")).join(documents, "doc_id", "left_semi").select("item_id", "doc_id")
    candidates = gold.where((F.col("item_id") + F.col("doc_id")) % 3 != 0).unionAll(near).distinct()
    order = Window.partitionBy("item_id").orderBy((F.col("doc_id") * 31 + F.col("item_id")) % 97, "doc_id")
    return items, gold, candidates.withColumn("rank", F.row_number().over(order))


@query(f"WITH {_RANKED} SELECT item_id, round(recall, 6) AS recall, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg, hit, first_rank FROM e")
def eval_case_metrics(spark, sf_dir):
    items, gold, found = judged(spark, sf_dir)
    return evaluation.case_metrics(items, gold, found, 10).select("item_id", *[F.round(c, 6).alias(c) for c in ("recall", "rr", "ndcg")], "hit", "first_rank")


@query(f"WITH {_RANKED} SELECT count(*) AS cases, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(CAST(hit AS INT)), 6) AS hit_rate FROM e")
def eval_aggregate(spark, sf_dir):
    items, gold, found = judged(spark, sf_dir)
    return evaluation.aggregate(evaluation.case_metrics(items, gold, found, 10))


_RUN = _RANKED + ", z AS (SELECT item_id, CASE WHEN item_id = 3 THEN 0 ELSE recall END AS recall, CASE WHEN item_id = 3 THEN 0 ELSE rr END AS rr, CASE WHEN item_id = 3 THEN 0 ELSE ndcg END AS ndcg, hit AND item_id <> 3 AS hit FROM e)"


@query(f"WITH {_RUN} SELECT count(*) AS cases, count(*) FILTER (item_id = 3) AS failed, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(CAST(hit AS INT)), 6) AS hit_rate FROM z")
def eval_run(spark, sf_dir):
    """The runner over all items as cases, one of which makes the search fail."""
    _, gold, found = judged(spark, sf_dir)
    held = corpus.once(spark, sf_dir, "judged", lambda: found)

    def search(cases):
        if not cases.where("item_id = 3").isEmpty():
            raise RuntimeError("no answer")
        return held.join(cases.select("item_id"), "item_id", "left_semi")

    metrics = evaluation.run(search, table(spark, sf_dir, "benchmark"), gold)
    failed = metrics.agg(F.count("error").alias("failed"))
    return evaluation.aggregate(metrics).drop("elapsed_ms").join(failed, F.lit(True))  # one row and one row


@query(f"""WITH {_RANKED}, e2 AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN ndcg / 2 ELSE ndcg END AS ndcg, rr FROM e WHERE item_id % 5 <> 0)
SELECT item_id, CASE WHEN abs(e2.ndcg - e.ndcg) > 1e-9 THEN CASE WHEN e2.ndcg > e.ndcg THEN 'improved' ELSE 'regressed' END WHEN abs(e2.rr - e.rr) > 1e-9 THEN CASE WHEN e2.rr > e.rr THEN 'improved' ELSE 'regressed' END ELSE 'unchanged' END AS verdict FROM e JOIN e2 USING (item_id) UNION ALL SELECT item_id, 'removed' FROM e WHERE item_id NOT IN (SELECT item_id FROM e2)""")
def eval_compare(spark, sf_dir):
    items, gold, found = judged(spark, sf_dir)
    base = evaluation.case_metrics(items, gold, found, 10)
    other = base.where("item_id % 5 != 0").withColumn("ndcg", F.when(F.col("item_id") % 3 == 0, F.col("ndcg") / 2).otherwise(F.col("ndcg")))
    return evaluation.compare(base, other)


@query("""WITH g AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))
SELECT item_id AS query_id, round(avg(CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.0 END), 6) AS context_recall FROM g GROUP BY item_id""")
def context_recall(spark, sf_dir):
    """Packed texts that have the headers of even documents, whose names may begin those of others."""
    gold = gold_of(spark, sf_dir).select(F.col("item_id").alias("query_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path"), "doc_id")
    sections = F.transform(F.sort_array(F.collect_list(F.when(F.col("doc_id") % 2 == 0, F.col("path")))), lambda p: F.concat(F.lit("## "), p, F.lit("\nLines 1-2")))
    packed = gold.groupBy("query_id").agg(F.array_join(sections, "\n\n").alias("output"))
    return evaluation.packed_recall(packed, gold).withColumn("context_recall", F.round("context_recall", 6))


@query("""SELECT path, score FROM (SELECT p_name AS path, CASE WHEN n = 'ste' THEN 0 WHEN starts_with(n, 'ste') THEN 1 WHEN contains(lower(p_name), 'ste') THEN 2 WHEN regexp_matches(lower(p_name), 's.*t.*e') THEN 3 END * 1000 + least(999, length(p_name)) AS score
FROM (SELECT p_name, string_split(lower(p_name), '/')[-1] AS n FROM (SELECT DISTINCT p_name FROM part))) WHERE score IS NOT NULL ORDER BY score, path LIMIT 12""")
def fuzzy_paths(spark, sf_dir):
    return lexical.fuzzy_paths(table(spark, sf_dir, "part").select(F.col("p_name").alias("path")).distinct(), "ste")


@query("SELECT doc_id AS rowid, source || '/' || doc_id AS path FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 5")
def symbol_lookup(spark, sf_dir):
    return chunks(spark, sf_dir).where("symbol = 'de'").orderBy("rowid").limit(5).select("rowid", "path")
