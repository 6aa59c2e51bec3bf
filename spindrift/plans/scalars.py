"""Queries over single rows: formats, risk, citations, scopes, transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.operators import logs
from spindrift.plans.registry import query, table


@query("""SELECT o_orderkey, CASE WHEN n < 1000 THEN CAST(CAST(floor(n + 0.5) AS BIGINT) AS VARCHAR) WHEN floor(n / 100 + 0.5) / 10 < 10 THEN printf('%.1f', floor(n / 100 + 0.5) / 10) || 'k'
WHEN floor(n / 100 + 0.5) / 10 < 1000 THEN CAST(CAST(floor(floor(n / 100 + 0.5) / 10 + 0.5) AS BIGINT) AS VARCHAR) || 'k' ELSE printf('%.1f', floor(n / 100000 + 0.5) / 10) || 'm' END AS shown
FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_totalprice / 1000 WHEN 1 THEN o_totalprice ELSE o_totalprice * 50 END AS n FROM orders)""")
def number_formats(spark, sf_dir):
    price = F.col("o_totalprice")
    n = F.when(F.col("o_orderkey") % 3 == 0, price / 1000).when(F.col("o_orderkey") % 3 == 1, price).otherwise(price * 50)
    return table(spark, sf_dir, "orders").select("o_orderkey", X.short_number(n).alias("shown"))


@query("SELECT p_partkey, p_name || ':' || p_size || '-' || (p_size + 9) AS citation FROM part")
def chunk_citations(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.citation(F.col("p_name"), F.col("p_size"), F.col("p_size") + 9).alias("citation"))


@query("""SELECT event_id, least(1.0, round(CASE event_type WHEN 'purchase' THEN 0.6 WHEN 'click' THEN 0.5 ELSE 0.25 END + least(0.25, 2 / 200.0) + least(0.25, user_id * 4 / 40.0) + CASE WHEN event_id % 4 = 0 THEN 0.2 ELSE 0 END, 2)) AS risk FROM events""")
def change_risk(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "remove").when(F.col("event_type") == "click", "shell").otherwise("edit")
    preview = F.when(F.col("event_id") % 4 == 0, "+a\n-b\n--- b\nrm -rf x").otherwise("+a\n-b\n c\n++d")
    return table(spark, sf_dir, "events").select("event_id", X.risk(kind, preview, F.col("user_id") * 4).alias("risk"))


@query("SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE text[1:280] || chr(10) || '... (truncated) ...' || chr(10) || right(text, 120) END AS shown FROM documents")
def truncated_results(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.truncated(F.col("text"), 400).alias("shown"))


@query("SELECT doc_id FROM documents WHERE ends_with(source || '/' || doc_id || '.py', '1.py') OR contains(source || '/' || doc_id || '.py', 'src3/')")
def guideline_scope(spark, sf_dir):
    path = F.concat_ws("", "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py"))
    return table(spark, sf_dir, "documents").where(X.in_scope(path, F.array(F.lit("*1.py"), F.lit("src3/")))).select("doc_id")


@query("""SELECT conv_id, string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations WHERE role IN ('user', 'assistant', 'tool') AND (role <> 'assistant' OR text <> '') GROUP BY conv_id""")
def transcript_render(spark, sf_dir):
    return logs.transcript(table(spark, sf_dir, "conversations"))
