"""Index queries: chunking, identity, maintenance, graph, packing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.operators import chunking, graph, lexical, maintenance, packing
from spindrift.plans.registry import query, table


def files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("contents"), F.col("lang").alias("language"), "doc_id")


_LINES = "SELECT source || '/' || doc_id AS path, string_split(text, chr(10)) AS l FROM documents WHERE text <> ''"
_WINDOWS = f"w AS (SELECT path, l, unnest(range(1, greatest(1, CAST(ceil((len(l) - 8) / 6.0) AS INT) * 6 + 1) + 1, 6)) AS s FROM ({_LINES})), c AS (SELECT path, CAST(s AS INT) AS start_line, CAST(least(s + 7, len(l)) AS INT) AS end_line, array_to_string(l[s:s + 7], chr(10)) AS contents FROM w)"


@query(f"WITH {_WINDOWS} SELECT path, start_line, end_line, length(contents) AS n_chars FROM c")
def chunk_lines(spark, sf_dir):
    return chunking.windows(files(spark, sf_dir), 8, 2).select("path", "start_line", "end_line", F.length("contents").cast("long").alias("n_chars"))


@query(f"WITH {_WINDOWS} SELECT path, start_line, sha256(path || ':' || start_line || '-' || end_line || contents) AS id FROM c")
def chunk_ids(spark, sf_dir):
    return chunking.windows(files(spark, sf_dir), 8, 2).select("path", "start_line", chunking.chunk_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("contents")).alias("id"))


@query()
def chunk_boundary(spark, sf_dir):
    return chunking.numbered(chunking.chunk_files(files(spark, sf_dir), 8, 2, 2000)).select("id", "path", "start_line", "end_line", F.length("contents").alias("n_chars"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.estimated_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, sha256(source || '/' || doc_id || text) AS identity FROM documents")
def sha_identity(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", F.sha2(F.concat("path", "contents"), 256).alias("identity"))


@query("SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("SELECT sha256(text) AS hash, bool_or(doc_id % 3 = 0) AS hit FROM documents GROUP BY 1")
def embed_cache_split(spark, sf_dir):
    wanted = table(spark, sf_dir, "documents").select(F.lit("m").alias("model"), F.lit(64).alias("dim"), F.sha2("text", 256).alias("hash"), "doc_id")
    return maintenance.cache_split(wanted, wanted.where("doc_id % 3 = 0")).select("hash", "hit")


def snapshots(spark, sf_dir):
    """What an index knows, and a later scan: some paths gone, some changed, some new."""
    known = files(spark, sf_dir).where("doc_id % 7 != 0").select("path", F.sha2("contents", 256).alias("hash"))
    current = files(spark, sf_dir).where("doc_id % 5 != 0").select("path", F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat("contents", F.lit("x"))).otherwise(F.col("contents")), 256).alias("hash"))
    return known, current


@query("""SELECT source || '/' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 5 = 0 THEN 'removed' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'same' END AS status FROM documents WHERE NOT (doc_id % 7 = 0 AND doc_id % 5 = 0)""")
def freshness_diff(spark, sf_dir):
    return maintenance.freshness(*snapshots(spark, sf_dir))


@query("SELECT source || '/' || doc_id AS path FROM documents WHERE doc_id % 5 = 0 AND (doc_id % 7 <> 0 OR doc_id % 2 = 0)")
def stale_sweep(spark, sf_dir):
    known, current = snapshots(spark, sf_dir)
    return maintenance.stale(known, files(spark, sf_dir).where("doc_id % 2 = 0"), current)


@query("SELECT user_id AS path, max_by(event_id, event_id) AS hash FROM events GROUP BY user_id")
def hash_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("hash"))
    return maintenance.latest(rows, "path", "hash")


@query("SELECT source AS path, count(*) AS n FROM documents GROUP BY source")
def chunk_count_by_path(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("path")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS chunks, count(DISTINCT source) AS files, max(n_chars) AS longest FROM documents")
def index_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("source").alias("files"), F.max("n_chars").alias("longest"))


@query("SELECT lang FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) ORDER BY n DESC, lang LIMIT 1")
def dominant_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(1).select("lang")


@query("SELECT DISTINCT source AS path FROM documents WHERE starts_with(source, 'src1') AND regexp_matches(source, '^src1[0-5]$')")
def list_files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("path")).distinct().where(F.col("path").startswith("src1") & F.col("path").rlike("^src1[0-5]$"))


_HREF = "e AS (SELECT DISTINCT page_id AS source, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages), k AS (SELECT *, row_number() OVER (ORDER BY source, target) AS id FROM e)"


def link_edges(spark, sf_dir):
    """Links of pages, numbered within their page; a bipartite graph of page numbers and targets."""
    links = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("target"))
    return links.distinct().withColumn("id", F.row_number().over(Window.partitionBy("source").orderBy("target")))


@query("SELECT DISTINCT 'p' || page_id AS source, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages")
def graph_edges_html(spark, sf_dir):
    return link_edges(spark, sf_dir).select("source", "target")


@query("""WITH e AS (SELECT DISTINCT 'p' || page_id AS source, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)
SELECT source AS seed, 'out' AS direction, target AS node FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY target) AS n FROM e) WHERE n <= 3 AND source IN ('p1', 'p2', 'p3')""")
def graph_neighbors(spark, sf_dir):
    seeds = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "seed string")
    return graph.neighbours(link_edges(spark, sf_dir), seeds, 3).select("seed", "direction", "node")


@query("""WITH e AS (SELECT DISTINCT 'p' || page_id AS s, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS t FROM pages), b AS (SELECT s AS a, t AS b FROM e UNION SELECT t, s FROM e), seed AS (SELECT unnest(['p1', 'p2', 'p3']) AS seed),
h1 AS (SELECT DISTINCT seed, b AS node FROM seed JOIN b ON a = seed), h2 AS (SELECT DISTINCT seed, b.b AS node FROM h1 JOIN b ON b.a = h1.node)
SELECT seed, node, CAST(min(hops) AS INT) AS hops FROM (SELECT seed, seed AS node, 0 AS hops FROM seed UNION ALL SELECT seed, node, 1 FROM h1 UNION ALL SELECT seed, node, 2 FROM h2) GROUP BY seed, node""")
def graph_bfs2(spark, sf_dir):
    return graph.reached(link_edges(spark, sf_dir), spark.createDataFrame([("p1",), ("p2",), ("p3",)], "seed string"))


@query("""WITH e AS (SELECT DISTINCT page_id AS source, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages) SELECT target, count(*) AS importers FROM e GROUP BY target HAVING count(*) > 1""")
def importers(spark, sf_dir):
    return link_edges(spark, sf_dir).groupBy("target").agg(F.countDistinct("source").alias("importers")).where("importers > 1")


_FK = """n AS (SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, 'imports' AS kind, 1.0 AS confidence, 'a' || n_nationkey AS id FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'calls', 0.7, 'b' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') FROM customer),
s AS (SELECT n_regionkey AS query_id, 'n' || n_nationkey AS node, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rank, 1.0 / (n_nationkey + 1) AS score FROM nation),
o AS (SELECT s.query_id, s.rank, s.score, 'out' AS direction, n.id, n.target AS node, kind, confidence, row_number() OVER (PARTITION BY s.node ORDER BY n.id) AS k FROM s JOIN n ON n.source = s.node WHERE rank <= 5),
i AS (SELECT s.query_id, s.rank, s.score, 'in' AS direction, n.id, n.source AS node, kind, confidence, row_number() OVER (PARTITION BY s.node ORDER BY n.id) AS k FROM s JOIN n ON n.target = s.node WHERE rank <= 5),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, node ORDER BY rank, direction DESC, id) AS nth FROM (SELECT * FROM o WHERE k <= 50 UNION ALL SELECT * FROM i WHERE k <= 50) x WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.query_id = x.query_id AND s.node = x.node)) WHERE nth = 1)
SELECT query_id, node, CAST(p AS INT) AS place, round(score * 0.55 * confidence, 6) AS score, CASE direction WHEN 'out' THEN kind || ' ' || node ELSE node || ' ' || kind || ' this' END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, direction DESC, id) AS p FROM h) WHERE p <= 15"""


@query("WITH " + _FK)
def fk_graph_expand(spark, sf_dir):
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    edges = nation.select(text("n", "n_nationkey").alias("source"), text("r", "n_regionkey").alias("target"), F.lit("imports").alias("kind"), F.lit(1.0).alias("confidence"), text("a", "n_nationkey").alias("id")).unionAll(
        customer.select(text("c", "c_custkey"), text("n", "c_nationkey"), F.lit("calls"), F.lit(0.7), F.concat(F.lit("b"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")))
    )
    rank = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    ranked = nation.select(F.col("n_regionkey").alias("query_id"), text("n", "n_nationkey").alias("node"), rank.alias("rank"), (1 / (F.col("n_nationkey") + 1)).alias("score"))
    return graph.expand(ranked, edges).withColumn("score", F.round("score", 6))


def result_rows(spark, sf_dir):
    """Windows of all documents' lines as results, with a score that any engine can compute: a query for each hundred doc_ids."""
    cut = chunking.windows(files(spark, sf_dir), 4, 1).withColumn("path", F.element_at(F.split("path", "/"), -1))
    n = F.col("path").cast("long")
    return cut.select(F.floor(n / 100).alias("query_id"), F.concat(F.lit("f"), (n % 50).cast("string")).alias("path"), (F.col("start_line") + n * 3).cast("int").alias("start_line"), (F.col("end_line") + n * 3).cast("int").alias("end_line"), "contents", ((n * 37 + F.col("start_line") * 11) % 101 / 10.0).alias("score"), n.alias("n"))


_RESULTS = f"""w AS (SELECT CAST(string_split(path, '/')[2] AS BIGINT) AS n, l, unnest(range(1, greatest(1, CAST(ceil((len(l) - 4) / 3.0) AS INT) * 3 + 1) + 1, 3)) AS s FROM ({_LINES})),
r AS (SELECT n // 100 AS query_id, 'f' || (n % 50) AS path, s + n * 3 AS start_line, least(s + 3, len(l)) + n * 3 AS end_line, (n * 37 + s * 11) % 101 / 10.0 AS score, n FROM w)"""


@query(f"WITH {_RESULTS} SELECT query_id, path, CAST(start_line AS INT) AS start_line, CAST(in_file AS INT) AS in_file FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, start_line, n) AS in_file FROM r) WHERE in_file <= 4")
def top_chunks_per_file(spark, sf_dir):
    rows = result_rows(spark, sf_dir).withColumn("rank", F.struct("start_line", "n"))
    return packing.top_per_file(rows).select("query_id", "path", "start_line", "in_file")


@query(f"""WITH {_RESULTS}, m AS (SELECT *, max(end_line) OVER (PARTITION BY query_id, path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN start_line <= reach + 8 THEN 0 ELSE 1 END) OVER (PARTITION BY query_id, path ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS span FROM m)
SELECT query_id, path, CAST(min(start_line) AS INT) AS start_line, CAST(max(end_line) AS INT) AS end_line, round(max(score), 4) AS score, count(*) AS n_chunks FROM i GROUP BY query_id, path, span""")
def span_merge(spark, sf_dir):
    return packing.merged_spans(result_rows(spark, sf_dir)).select("query_id", "path", "start_line", "end_line", F.round("score", 4).alias("score"), "n_chunks")


@query()
def pack_budget(spark, sf_dir):
    """All documents' windows, a query for each hundred documents."""
    rows = result_rows(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "n", "start_line"))
    return packing.pack(rows.withColumn("rank", rank).withColumn("symbol", F.lit("Thing")), 8000, 3000)


_MAP = """d AS (SELECT source AS path, lang AS symbol, min(doc_id) AS start_line FROM documents GROUP BY ALL), w AS (SELECT path, count(*) AS weight FROM d GROUP BY path),
l AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY start_line, symbol) AS k, row_number() OVER (ORDER BY weight DESC, path, start_line, symbol) AS place FROM d JOIN w USING (path)),
u AS (SELECT *, 58 + sum(CASE WHEN k = 1 THEN length(path) + 3 ELSE 2 END + length('sym ' || symbol || ' (' || start_line || '-' || start_line || ')') + 1) OVER (ORDER BY place) AS used FROM l)"""


@query(f"WITH {_MAP.replace('58', '(SELECT length(' + chr(39) + 'Repository map (files → declared symbols; line ranges):' + chr(39) + '))')} SELECT CAST(place AS INT) AS place, path, symbol FROM u WHERE used <= 1000")
def repo_map(spark, sf_dir):
    symbols = table(spark, sf_dir, "documents").select(F.col("source").alias("path"), F.col("lang").alias("symbol"), F.col("doc_id").alias("start_line"), F.col("doc_id").alias("end_line"))
    return packing.repo_map(symbols, 1000)


@query("""SELECT a.rowid AS anchor, b.rowid AS rowid, CAST(rank AS INT) AS rank, gap FROM (SELECT a.k AS a_k, b.k AS b_k, row_number() OVER (PARTITION BY a.k ORDER BY CASE WHEN b.e < a.s THEN a.s - b.e ELSE b.s - a.e END, b.k) AS rank, CASE WHEN b.e < a.s THEN a.s - b.e ELSE b.s - a.e END AS gap
FROM (SELECT doc_id AS k, source AS p, doc_id * 10 AS s, doc_id * 10 + 15 AS e FROM documents) a JOIN (SELECT doc_id AS k, source AS p, doc_id * 10 AS s, doc_id * 10 + 15 AS e FROM documents) b ON a.p = b.p AND a.k <> b.k) x, (SELECT doc_id AS rowid FROM documents) a, (SELECT doc_id AS rowid FROM documents) b WHERE a.rowid = a_k AND b.rowid = b_k AND rank <= 4""")
def proximity_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rowid"), F.col("source").alias("path"), (F.col("doc_id") * 10).alias("start_line"), (F.col("doc_id") * 10 + 15).alias("end_line"))
    return lexical.near(rows, rows).select("anchor", "rowid", "rank", "gap")


@query("SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'key' WHEN length(text) > 5000 THEN 'size' WHEN regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') THEN 'binary' ELSE 'kept' END AS reason FROM documents")
def scan_filter(spark, sf_dir):
    named = F.when(F.col("doc_id") % 18 == 0, F.lit(".ssh/x")).when(F.col("doc_id") % 9 == 0, F.concat("path", F.lit("/.env.local"))).otherwise(F.col("path"))
    reason = F.when(X.is_key_path(named), "key").when(F.length("contents") > 5000, "size").when(X.is_binary(F.col("contents").cast("binary")), "binary").otherwise("kept")
    return files(spark, sf_dir).select("doc_id", reason.alias("reason"))


_ENDINGS = [(e, language) for language, endings in X.LANGUAGES.items() for e in endings.split()] + [("txt", None), ("PY", "python"), ("", None)]


@query("SELECT p_partkey, CASE p_partkey % " + str(len(_ENDINGS)) + " " + " ".join(f"WHEN {n} THEN {'NULL' if language is None else repr(language)}" for n, (_, language) in enumerate(_ENDINGS)) + " END AS language FROM part")
def language_map(spark, sf_dir):
    endings = F.array(*[F.lit(e) for e, _ in _ENDINGS])
    return table(spark, sf_dir, "part").select("p_partkey", X.language_of(F.concat(F.lit("a/b."), F.element_at(endings, (F.col("p_partkey") % len(_ENDINGS) + 1).cast("int")))).alias("language"))


@query("SELECT p_partkey, CASE WHEN contains(trim(regexp_replace(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_-]+', ' ', 'g')), ' ') THEN trim(regexp_replace(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_-]+', ' ', 'g')) ELSE '' END AS words FROM part")
def identifier_split(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.split_identifier(F.col("p_name")).alias("words"))
