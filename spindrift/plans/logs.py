"""Queries over event logs, conversations and notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.operators import logs, maintenance, memory
from spindrift.plans.registry import query, table

_CHAIN = """WITH RECURSIVE b AS (SELECT event_id AS seq, event_id // 50 AS part, min(event_id) OVER (PARTITION BY event_id // 50) AS first, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type AS type, coalesce(props, '') AS data FROM events),
c AS (SELECT seq, part, sha256(seq || '|' || ts || '|' || type || '|' || data || '|') AS hash FROM b WHERE seq = first
 UNION ALL SELECT b.seq, b.part, sha256(b.seq || '|' || b.ts || '|' || b.type || '|' || b.data || '|' || c.hash) FROM c JOIN b ON b.seq = c.seq + 1 AND b.part = c.part)"""


@query(_CHAIN + """ SELECT part, min(seq) AS seq, min_by(reason, seq) AS reason, min_by(hash, seq) AS was FROM (SELECT part, seq, hash, CASE WHEN part % 4 = 1 AND seq % 50 = 20 THEN 'hash' WHEN part % 4 = 2 AND seq % 50 = 31 THEN 'gap' WHEN part % 4 = 3 AND seq % 50 = 8 THEN 'hash' END AS reason FROM c) WHERE reason IS NOT NULL GROUP BY part""")
def audit_chain_verify(spark, sf_dir):
    """Logs of fifty events each, chained by hashes; in some a record is altered, lost, or rewritten with its hash left."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("seq"), F.floor(F.col("event_id") / 50).alias("part"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("event_type").alias("type"), F.coalesce("props", F.lit("")).alias("data"))
    chained = rows.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("seq", "ts", "type", "data"))).alias("r")).select("part", F.inline(logs.chained(F.col("r"))))
    at, kind = F.col("seq") % 50, F.col("part") % 4
    altered = chained.withColumn("data", F.when((kind == 1) & (at == 20), F.concat("data", F.lit("!"))).otherwise(F.col("data"))).withColumn("type", F.when((kind == 3) & (at == 8), "other").otherwise(F.col("type")))
    return logs.chain_breaks(altered.where(~((kind == 2) & (at == 30))), "part").join(chained.select("seq", F.col("hash").alias("was")), "seq").select("part", "seq", "reason", "was")


@query("SELECT event_id, event_type FROM (SELECT * FROM events WHERE event_id > 500 ORDER BY event_id DESC LIMIT 2000)")
def event_cursor(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_id > 500").orderBy(F.desc("event_id")).limit(2000).select("event_id", "event_type")


@query("SELECT event_id, times FROM (SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS INT) AS times FROM events) WHERE times >= 2")
def loop_detect(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("seq"), F.col("user_id").alias("session"), F.col("event_type").alias("signature"))
    return logs.repeated_calls(rows).select("event_id", "times")


@query("SELECT user_id AS path, CASE WHEN max_by(event_type, event_id) = 'purchase' THEN 'unlink' ELSE 'change' END AS op, max(event_id) AS seq FROM events GROUP BY user_id")
def last_op_wins(spark, sf_dir):
    op = F.when(F.col("event_type") == "purchase", "unlink").otherwise("change")
    return maintenance.last_operations(table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), op.alias("op"), F.col("event_id").alias("seq")))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh, event_id FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS n, CAST(floor(epoch(min(ts))) AS BIGINT) AS began FROM s GROUP BY user_id, k""")
def debounce_sessions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    gap = rows.groupBy("user_id", F.session_window("ts", "6 hours 1 microsecond").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return gap.select("user_id", "n", F.unix_seconds("w.start").alias("began"))


_TOKENS = "CAST(ceil(length(text) / 4.0) AS BIGINT) + 4"


@query(f"SELECT conv_id, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' ELSE 'history' END AS bucket, CAST(sum({_TOKENS}) AS BIGINT) AS tokens FROM conversations GROUP BY ALL")
def context_ledger(spark, sf_dir):
    return logs.buckets(table(spark, sf_dir, "conversations")).select("conv_id", "bucket", "tokens")


@query(f"""WITH b AS (SELECT conv_id, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' ELSE 'history' END AS bucket, sum({_TOKENS}) AS t FROM conversations GROUP BY ALL)
SELECT conv_id, bucket, round(100 * t / sum(t) OVER (PARTITION BY conv_id), 4) AS percent FROM b""")
def budget_split(spark, sf_dir):
    return logs.buckets(table(spark, sf_dir, "conversations")).select("conv_id", "bucket", F.round(100 * F.col("share"), 4).alias("percent"))


@query(f"""WITH t AS (SELECT conv_id, turn, role, {_TOKENS} AS tk FROM conversations), w AS (SELECT *, sum(tk) OVER (PARTITION BY conv_id) AS total, count(*) OVER (PARTITION BY conv_id) AS n, coalesce(turn = min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id), false) AS head FROM t),
x AS (SELECT *, coalesce(sum(CASE WHEN head THEN tk END) OVER (PARTITION BY conv_id), 0) AS base, sum(CASE WHEN head THEN 0 ELSE tk END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rest, sum(CASE WHEN head THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM w)
SELECT conv_id, turn FROM x WHERE n <= 2 OR total <= 400 OR head OR place = 1 OR base + rest <= 400""")
def history_compaction(spark, sf_dir):
    return logs.compacted(table(spark, sf_dir, "conversations"), 400)


@query("SELECT conv_id, turn, CAST(sum(CAST(role = 'user' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS user_turn, CASE role WHEN 'user' THEN 'prompt' WHEN 'assistant' THEN 'text' ELSE 'context' END AS event FROM conversations")
def transcript_replay(spark, sf_dir):
    return logs.replayed(table(spark, sf_dir, "conversations"))


def notes(spark, sf_dir):
    """Answers as notes, an hour older for each turn and conversation."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content"), F.array(F.lit("thing"), F.col("role")).alias("tags"), (F.col("conv_id") * 3 + F.col("turn")).cast("double").alias("age_hours"), F.lit(1.0).alias("relevance"))


_NOTES = "n AS (SELECT conv_id * 1000 + turn AS id, text, conv_id * 3 + turn AS age FROM conversations WHERE role = 'assistant'), w AS (SELECT *, regexp_extract_all(lower(text), '[a-z0-9_]{3,}') AS t FROM n)"
_SCORE = " + ".join(f"(CASE WHEN list_contains(t, '{q}') THEN 1 ELSE 0 END) + {tag} + 0.3 * len(list_filter(t, lambda x: contains(x, '{q}') OR contains('{q}', x)))" for q, tag in (("the", 0), ("thing", 2), ("und", 0)))


@query(f"""WITH {_NOTES}, r AS (SELECT id, age, {_SCORE} AS raw FROM w), s AS (SELECT id, raw / greatest(max(raw) OVER (), 1e-9) / (1 + age * 0.01) AS score FROM r)
SELECT id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY round(score, 9) DESC, id LIMIT 20""")
def memory_recall_lexical(spark, sf_dir):
    return memory.recall(notes(spark, sf_dir), "the thing und", 20).select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {_NOTES}, d AS (SELECT id, text, list_distinct(t) AS t FROM w), known AS (SELECT * FROM d WHERE id % 2 = 0), c AS (SELECT * FROM d WHERE id % 2 = 1)
SELECT id FROM c WHERE NOT EXISTS (SELECT 1 FROM known k WHERE lower(k.text) = lower(c.text) OR (len(k.t) > 0 AND len(c.t) > 0 AND len(list_intersect(k.t, c.t)) >= 0.8 * least(len(k.t), len(c.t))))""")
def memory_dedupe(spark, sf_dir):
    rows = notes(spark, sf_dir).select("id", "content")
    return memory.not_paraphrased(rows.where("id % 2 = 1"), rows.where("id % 2 = 0")).select("id")


@query(f"WITH {_NOTES} SELECT id FROM n WHERE age / 24.0 < 10 ORDER BY round(1 / (1 + age / 24.0), 9) DESC, id LIMIT 50")
def memory_prune(spark, sf_dir):
    return memory.pruned(notes(spark, sf_dir).withColumn("age_days", F.col("age_hours") / 24), 10, 50).select("id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '\\bAKIA[0-9A-Z]{16}\\b') OR regexp_matches(text, '(?i)\\b(?:api[-_ ]?key|secret|token|password|passwd|credential)s?\\b\\s*[:=]\\s*\\S{8,}') OR regexp_matches(text, '\\b(?:sk|pk|rk|pa|ghp|gho|ghu|ghs|xox[a-z])[-_][A-Za-z0-9_\\-]{16,}') OR regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') OR regexp_matches(text, '\\bAIza[0-9A-Za-z_\\-]{30,}')")
def secret_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(X.looks_like_secret(F.col("text"))).select("doc_id")


@query("SELECT conv_id, turn, array_to_string(list_slice(list_distinct_kept, 1, 5), ',') AS tags FROM (SELECT conv_id, turn, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_kept FROM (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '[A-Z][a-z]+[A-Z][A-Za-z0-9_]+|[a-z_]{4,}'), lambda t: lower(t)) AS l FROM conversations))")
def note_tags(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(X.tags(F.col("text")), ",").alias("tags"))
