"""What surrounds a search: classifiers, formats, diffs, policies, the window's ledger, checkpoints and notes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.operators import diff, ledger, logs, memory, policy, review
from spindrift.plans.registry import query, table
from spindrift.plans.retrieval import _CHUNKS, line_chunks

_TASKS = ["refactor the store", "what is a chunk", "please explain why it fails", "fix it", "can you look? and then? tell", "optimize the entire build", "a question of middling length that says neither this nor that to anyone", "convert all callers", "list the files", "end-to-end test"]
_TIERS = ["reasoning", "fast", "reasoning", None, "reasoning", "reasoning", "standard", None, None, "reasoning"]
_STEPS = ["complex", "simple", "simple", "simple", "complex", "complex", "simple", "complex", "simple", "simple"]


def _literals(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)


@query(f"""SELECT o_orderkey, coalesce(tier, CASE WHEN o_custkey % 9 > 5 THEN 'reasoning' ELSE 'fast' END) AS tier, steps FROM orders JOIN (VALUES {_literals([(n, *x) for n, x in enumerate(zip(_TIERS, _STEPS, strict=True))])}) v(n, tier, steps) ON n = o_orderkey % {len(_TASKS)}
WHERE NOT (n = 6 AND o_custkey % 9 > 5)""")
def query_complexity(spark, sf_dir):
    """Which model and how many steps a request is given; the length of the talk decides where the words do not."""
    text = F.element_at(F.array(*map(F.lit, _TASKS)), (F.col("o_orderkey") % len(_TASKS) + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").where(f"NOT (o_orderkey % {len(_TASKS)} = 6 AND o_custkey % 9 > 5)")
    return rows.select("o_orderkey", X.model_tier(text, F.col("o_custkey") % 9).alias("tier"), X.step_class(text).alias("steps"))


_TYPED = ["look at @src/a.ts. and @b", "!ls -la", "/Help  me now", "  ", "mail a@b.com, (@x/y.py)!", "/", "see @a @a,"]


@query("SELECT p_partkey, kind, name, rest, mentions FROM part JOIN (VALUES " + _literals([(0, "prompt", None, "look at @src/a.ts. and @b", "src/a.ts|b"), (1, "shell", None, "ls -la", ""), (2, "command", "help", "me now", ""), (3, "empty", None, None, ""), (4, "prompt", None, "mail a@b.com, (@x/y.py)!", ""), (5, "empty", None, None, ""), (6, "prompt", None, "see @a @a,", "a")]) + f") v(n, kind, name, rest, mentions) ON n = p_partkey % {len(_TYPED)}")
def mentions(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, _TYPED)), (F.col("p_partkey") % len(_TYPED) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", X.composed(text).alias("c"), F.array_join(X.mentions(text), "|").alias("mentions")).select("p_partkey", "c.kind", "c.name", "c.rest", "mentions")


_BEFORE = ["look at @sr", "a@b", "/he", "x /he", "@", "done @a b", "hi\n@q"]


@query("SELECT p_partkey, trigger, query, start FROM part JOIN (VALUES " + _literals([(0, "@", "sr", 8), (1, None, None, None), (2, "/", "he", 0), (3, None, None, None), (4, "@", "", 0), (5, None, None, None), (6, "@", "q", 3)]) + f") v(n, trigger, query, start) ON n = p_partkey % {len(_BEFORE)}")
def active_tokens(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, _BEFORE)), (F.col("p_partkey") % len(_BEFORE) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", X.active_token(text).alias("t")).select("p_partkey", "t.trigger", "t.query", "t.start")


_MODELS = [("gemini-2.5-pro", 1_000_000), ("some-claude-x", 200_000), ("gpt-5-mini", 272_000), ("o3", 200_000), ("gpt-4.1-nano", 128_000), ("qwen2.5-coder", 32_000), ("unheard-of", 128_000)]


@query("SELECT p_partkey, w AS context_window FROM part JOIN (VALUES " + _literals([(n, w) for n, (_, w) in enumerate(_MODELS)]) + f") v(n, w) ON n = p_partkey % {len(_MODELS)}")
def model_windows(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(m) for m, _ in _MODELS]), (F.col("p_partkey") % len(_MODELS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", X.context_window(name).alias("context_window"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN least(60000.0, (event_id % 90) * 1000.0) WHEN 1 THEN 60000.0 WHEN 2 THEN 30000.0 WHEN 3 THEN 0.0 END AS wait_ms, CASE event_id % 5 WHEN 0 THEN event_id % 2 = 0 WHEN 4 THEN true ELSE false END AS auth FROM events""")
def retry_rules(spark, sf_dir):
    key = F.col("event_id") % 5
    value = F.when(key == 0, (F.col("event_id") % 90).cast("string")).when(key == 1, "Wed, 31 Jan 2024 13:00:00 GMT").when(key == 2, "Wed, 31 Jan 2024 12:00:30 GMT").when(key == 3, "Wed, 31 Jan 2024 11:00:00 GMT").otherwise("soon")
    status = F.when(key == 0, F.when(F.col("event_id") % 2 == 0, 401).otherwise(500))
    message = F.when(key == 4, "VOYAGE_API_KEY is required").otherwise("HTTP 500")
    now = F.to_timestamp(F.lit("2024-01-31 12:00:00"))
    return table(spark, sf_dir, "events").select("event_id", X.retry_after_ms(value, now).alias("wait_ms"), X.is_auth_error(status, message).alias("auth"))


@query(f"""WITH {_CHUNKS} SELECT rowid, path || ':' || start_line || '-' || end_line || chr(10) || (SELECT string_agg(lpad(CAST(start_line + i - 1 AS VARCHAR), 5, ' ') || ' │ ' || line, chr(10) ORDER BY i) FROM (SELECT unnest(string_split(contents, chr(10))) AS line, generate_subscripts(string_split(contents, chr(10)), 1) AS i)) AS shown,
symbol || ' (in ' || parent || ') — ' || path || ':' || start_line || '-' || end_line || chr(10) || '```' || chr(10) || CASE WHEN len(string_split(contents, chr(10))) > 2 THEN array_to_string(string_split(contents, chr(10))[1:2], chr(10)) || chr(10) || '… (' || (len(string_split(contents, chr(10))) - 2) || ' more lines — read-file for the rest)' ELSE contents END || chr(10) || '```' AS definition FROM c""")
def result_formats(spark, sf_dir):
    rows = line_chunks(spark, sf_dir)
    null = F.lit(None).cast("string")
    return rows.select("rowid", X.shown_result(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("contents")).alias("shown"), X.shown_definition(F.col("symbol"), null, F.col("parent"), F.col("path"), F.col("start_line"), F.col("end_line"), null, F.col("contents"), 2).alias("definition"))


@query(f"""WITH {_CHUNKS}, x AS (SELECT *, list_filter(list_transform(range(1, len(string_split(contents, chr(10))) + 1), lambda i: {{'n': start_line + i - 1, 'line': string_split(contents, chr(10))[i]}}), lambda e: regexp_matches(e.line, '(^|[^A-Za-z0-9_])(token|the)([^A-Za-z0-9_]|$)')) AS hits FROM c)
SELECT rowid, array_to_string(list_concat([path || ':' || start_line || '-' || end_line || ' (symbol ' || symbol || ')'], list_transform(list_filter(hits, lambda e: regexp_matches(e.line, '(^|[^A-Za-z0-9_])the([^A-Za-z0-9_]|$)'))[1:3], lambda e: '  ' || path || ':' || e.n || ': ' || trim(e.line)[1:160])), chr(10)) AS shown FROM x""")
def reference_lines(spark, sf_dir):
    rows = line_chunks(spark, sf_dir)
    return rows.select("rowid", X.shown_reference(F.lit("the"), F.col("path"), F.col("start_line"), F.col("end_line"), F.col("symbol"), F.lit(None).cast("string"), F.col("contents")).alias("shown"))


@query("""SELECT doc_id, (length(text) - length(replace(text, 'an', ''))) // 2 AS times, CASE WHEN contains(text, 'an') THEN text[1:strpos(text, 'an') - 1] || '<' || text[strpos(text, 'an') + 2:] ELSE text END AS once FROM documents""")
def text_replacements(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.occurrences(text, "an").alias("times"), X.replaced_once(text, "an", "<").alias("once"))


def _edited():
    """documents.text with another third line and a line more."""
    changed = F.transform(F.split("text", "\n"), lambda x, n: F.when(n == 2, F.lit("¤ another line")).otherwise(x))
    return F.array_join(F.concat(changed, F.array(F.lit("¤ one more"))), "\n")


@query("""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, CAST(1 + CASE WHEN len(l) > 2 THEN 1 ELSE 0 END AS BIGINT) AS added, CAST(CASE WHEN len(l) > 2 THEN 1 ELSE 0 END AS BIGINT) AS removed FROM l WHERE text <> ''""")
def diff_stat(spark, sf_dir):
    """Diffs of documents whose third line is changed and that gain a line, counted."""
    new = _edited()
    rows = table(spark, sf_dir, "documents").where("text != ''").select("doc_id", X.diff_stat(diff.unified_diff(F.col("text"), new)).alias("s"))
    return rows.select("doc_id", "s.added", "s.removed")


@query(f"""WITH l AS (SELECT doc_id, source || '/' || doc_id AS path, len(string_split(text, chr(10))) AS n FROM documents WHERE text <> ''), h AS (
SELECT doc_id, path, 'L' || (n + 1) || ': ¤ one more' AS last, CASE WHEN n > 2 THEN '  @@ +1' || chr(10) || 'L3: ¤ another line' || chr(10) ELSE '  @@ +1' || chr(10) END || CASE WHEN n < 9 THEN '' ELSE '  @@ +' || (n - 2) || chr(10) END AS head FROM l)
SELECT doc_id, concat_ws(chr(10), '{review.ASK}', '', '{review.ADVICE}', CASE WHEN doc_id % 2 = 0 THEN chr(10) || '{review.NEW_FILES}' || path || '.new, ' || path || '.test' END, CASE WHEN doc_id % 3 = 0 THEN chr(10) || '{review.DELETED_FILES}' || path || '.old' END, '',
'File: ' || path || chr(10) || head || last, 'File: ' || path || '.long' || chr(10) || '  @@ +7' || chr(10) || (SELECT string_agg('L' || (7 + k) || ': ' || k, chr(10) ORDER BY k) FROM range(40) AS r(k))) AS review FROM h""")
def review_queries(spark, sf_dir):
    """Each document's edit, a file of 60 added lines and one that only loses a line, as a review with new and deleted files."""
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    named = lambda end: F.concat(F.lit("--- a/"), path, F.lit(f"{end}\n+++ b/"), path, F.lit(f"{end}\n"))
    edit = F.concat(named(""), F.substring(diff.unified_diff(F.col("text"), _edited()), len("--- a\n+++ b\n") + 1, (1 << 31) - 1))
    more = F.concat(named(".long"), F.lit("@@ -6,1 +7,60 @@\n-gone\n" + "".join(f"+{k}\n" for k in range(60))), named(".short"), F.lit("@@ -1,2 +1,1 @@\n here\n-gone\n"))
    new = F.when(F.col("doc_id") % 2 == 0, F.array(F.concat(path, F.lit(".new")), F.concat(path, F.lit(".test"))))
    old = F.when(F.col("doc_id") % 3 == 0, F.array(F.concat(path, F.lit(".old"))))
    whole = F.concat(edit, F.when(edit.endswith("\n"), "").otherwise("\n"), more)
    return table(spark, sf_dir, "documents").where("text != ''").select("doc_id", review.review_query(whole, new, old).alias("review"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN 'src/p' || p_partkey || '.ts' END AS path, CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN 7 END AS start_line, CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN 9 END AS end_line FROM part")
def citations_found(spark, sf_dir):
    key = F.col("p_partkey") % 3
    text = F.when(key == 0, F.concat(F.lit("see src/p"), F.col("p_partkey").cast("string"), F.lit(".ts:"), F.col("p_size").cast("string"), F.lit(" there"))).when(key == 1, F.concat(F.lit("(src/p"), F.col("p_partkey").cast("string"), F.lit(".ts:7-9)"))).otherwise("nothing: 7-9")
    return table(spark, sf_dir, "part").select("p_partkey", X.cited(text).alias("c")).select("p_partkey", "c.path", "c.start_line", "c.end_line")


@query("""SELECT 'c' || o_custkey AS scope, bool_and(CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false END) AS edits, bool_or(CASE WHEN o_orderkey % 5 = 0 THEN true END) AS sandbox, min(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 1000 END) AS shell_ms,
array_to_string(list_filter(['ls', 'git', 'rm'], lambda c: count(*) FILTER (o_orderkey % 2 = 0) > 0 AND NOT list_contains(list(CASE WHEN o_orderkey % 2 = 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'ls' WHEN 1 THEN 'git' ELSE 'rm' END END), c)), ',') AS allowed, count(*) FILTER (o_orderkey % 2 = 0) > 0 AS pinned,
count(DISTINCT CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 7 END) AS n_ignored FROM orders GROUP BY o_custkey""")
def policy_merge(spark, sf_dir):
    """Each customer's orders as sources of rules."""
    key = F.col("o_orderkey")
    commands = F.array(*map(F.lit, ("ls", "git", "rm")))
    without = F.element_at(commands, (key % 3 + 1).cast("int"))
    null = lambda kind: F.lit(None).cast(kind)
    rules = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("scope"), key.cast("int").alias("place"), key.cast("string").alias("source"), F.when(key % 4 == 0, True).when(key % 4 == 1, False).alias("edits"), null("boolean").alias("shell"),
        F.when(key % 2 == 0, F.filter(commands, lambda c: c != without)).alias("shell_allowed"), F.when(key % 3 > 0, key % 1000).alias("shell_ms"), F.when(key % 5 == 0, True).alias("sandbox"), null("boolean").alias("web"), null("array<string>").alias("providers"),
        null("boolean").alias("local_only"), F.when(key % 7 > 0, F.array((key % 7).cast("string"))).alias("ignore"), null("boolean").alias("audit"),
    )
    out = policy.merged(rules)
    return out.select("scope", "edits", "sandbox", "shell_ms", F.array_join(F.coalesce("shell_allowed", F.array().cast("array<string>")), ",").alias("allowed"), F.col("shell_allowed").isNotNull().alias("pinned"), F.size("ignore").cast("long").alias("n_ignored"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 1 THEN 'local only' WHEN p_partkey % 5 = 0 AND p_partkey % 3 = 2 THEN 'not allowed' WHEN p_partkey % 5 = 0 AND p_partkey % 3 = 1 THEN 'not allowed' END AS problem,
CASE WHEN p_partkey % 2 = 0 THEN 'embeddings: local-only' WHEN p_partkey % 5 = 0 THEN 'embedding providers: [voyage]' ELSE 'no restrictions' END AS told, CASE p_partkey % 4 WHEN 0 THEN 'ls,git' WHEN 1 THEN 'git' WHEN 2 THEN 'rm' ELSE 'ls' END AS commands FROM part""")
def policy_checks(spark, sf_dir):
    key = F.col("p_partkey")
    provider = F.element_at(F.array(*map(F.lit, ("voyage", "ollama", "openai"))), (key % 3 + 1).cast("int"))
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", provider.alias("provider"), (key % 2 == 0).alias("local_only"), F.when(key % 5 == 0, F.array(F.lit("voyage"))).alias("providers"), F.lit(None).cast("boolean").alias("edits"), F.lit(True).alias("shell"), F.lit(None).cast("array<string>").alias("shell_allowed"), F.lit(True).alias("web"), none.alias("ignore"), F.lit(False).alias("audit"),
    )
    pinned = F.when(key % 4 == 2, F.lit(None).cast("array<string>")).otherwise(F.array(F.lit("ls"), F.lit("git")))
    asked = F.when(key % 4 == 0, none).when(key % 4 == 1, F.array(F.lit("rm"), F.lit("git"))).when(key % 4 == 2, F.array(F.lit("rm"))).otherwise(F.array(F.lit("ls")))
    return rows.select("p_partkey", policy.provider_problem(F.col("provider"), F.col("local_only"), F.col("providers")).alias("problem"), policy.described(rows).alias("told"), F.array_join(policy.shell_commands(pinned, asked), ",").alias("commands"))


def noted(spark, sf_dir):
    """Views and searches as entries of a window; carts and purchases as what is done to them."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), "event_type", (F.col("event_id") % 6).alias("k"))
    entry = F.concat_ws(":", "session", F.col("k").cast("string"))
    call = F.when(F.col("k") < 3, F.concat(F.lit("call"), F.col("k").cast("string")))
    notes = rows.where("event_type in ('view', 'click')").select(entry.alias("id"), "session", "seq", F.when(F.col("k") < 3, "retrieval").when(F.col("k") < 5, "files").otherwise("memory").alias("bucket"), F.concat(F.lit("p"), F.col("k").cast("string")).alias("label"), (F.col("seq") % 97).alias("tokens"), F.floor(F.col("seq") / 100).alias("turn"), (F.col("seq") % 13 / 13).alias("score"), call.alias("call"))
    kinds = F.element_at(F.array(*map(F.lit, ("pin", "evict", "unpin", "restore"))), (F.col("seq") % 4 + 1).cast("int"))
    flags = rows.where("event_type not in ('view', 'click')").select(entry.alias("id"), "seq", kinds.alias("action"))
    return notes, flags


_LEDGER = """r AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id AS seq, event_type, event_id % 6 AS k, user_id || ':' || (event_id % 6) AS id FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS nth, min(seq) OVER (PARTITION BY id) AS first FROM r WHERE event_type IN ('view', 'click')),
a AS (SELECT r.id, r.seq, ['pin', 'evict', 'unpin', 'restore'][CAST(r.seq % 4 + 1 AS INT)] AS action FROM r JOIN (SELECT id, min(first) AS first FROM n GROUP BY id) f ON f.id = r.id AND r.seq > f.first WHERE event_type NOT IN ('view', 'click')),
f AS (SELECT id, coalesce(max_by(action = 'pin', seq) FILTER (action IN ('pin', 'unpin', 'evict')), false) AS pinned, coalesce(max_by(action = 'evict', seq) FILTER (action IN ('evict', 'restore', 'pin')), false) AS evicted FROM a GROUP BY id),
e AS (SELECT n.id, n.session, CASE WHEN k < 3 THEN 'retrieval' WHEN k < 5 THEN 'files' ELSE 'memory' END AS bucket, 'p' || k AS label, seq % 97 AS tokens, seq // 100 AS turn, (seq % 13) / 13.0 AS score, CASE WHEN k < 3 THEN 'call' || k END AS call, coalesce(pinned, false) AS pinned, coalesce(evicted, false) AS evicted FROM n LEFT JOIN f USING (id) WHERE nth = 1)"""


@query(f"WITH {_LEDGER} SELECT id, pinned, evicted, CAST(row_number() OVER (PARTITION BY session ORDER BY turn DESC, score DESC, label, id) AS INT) AS place FROM e")
def ledger_order(spark, sf_dir):
    return ledger.ordered(ledger.entries(*noted(spark, sf_dir))).select("id", "pinned", "evicted", "place")


@query(f"""WITH {_LEDGER}, m AS (SELECT CAST(conv_id AS VARCHAR) AS session, 'call' || (turn % 5) AS call, text FROM conversations),
u AS (SELECT session, bucket, tokens FROM e WHERE NOT evicted UNION ALL SELECT m.session, 'history', CAST(ceil(length(text) / 4.0) AS BIGINT) + 4 FROM m WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.session = m.session AND e.call = m.call))
SELECT session, bucket, CAST(sum(tokens) AS BIGINT) AS tokens FROM u GROUP BY ALL""")
def ledger_snapshot(spark, sf_dir):
    messages = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session"), F.concat(F.lit("call"), (F.col("turn") % 5).cast("string")).alias("call"), "text")
    return ledger.snapshot(ledger.entries(*noted(spark, sf_dir)), messages)


@query(f"""WITH {_LEDGER}, g AS (SELECT session, call, count(*) FILTER (evicted) AS lost, count(*) AS n FROM e WHERE call IS NOT NULL GROUP BY ALL)
SELECT conv_id, turn, CASE WHEN coalesce(lost, 0) = 0 THEN text WHEN lost = n THEN 'No results retained for this search.' || chr(10) || chr(10) || '[' || lost || CASE WHEN lost = 1 THEN ' result' ELSE ' results' END || ' evicted from context by the user]' ELSE '[retrieval results evicted from context by the user]' END AS text
FROM conversations LEFT JOIN g ON g.session = CAST(conv_id AS VARCHAR) AND g.call = 'call' || (turn % 5)""")
def ledger_rewrite(spark, sf_dir):
    """Messages as they are sent on when entries were evicted."""
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("conv_id").cast("string").alias("session"), F.concat(F.lit("call"), (F.col("turn") % 5).cast("string")).alias("call"), "text")
    return ledger.rewritten(messages, ledger.entries(*noted(spark, sf_dir))).select("conv_id", "turn", "text")


def edited(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("path"))


@query("WITH c AS (SELECT user_id, median_seq FROM (SELECT user_id, max(event_id) FILTER (event_id % 10 = 0) AS median_seq FROM events GROUP BY user_id) WHERE median_seq IS NOT NULL) SELECT DISTINCT e.user_id AS session, event_type AS path FROM events e JOIN c USING (user_id) WHERE event_id > median_seq")
def changed_since(spark, sf_dir):
    """Paths edited after each session's last checkpoint."""
    edits = edited(spark, sf_dir)
    return ledger.changed_since(edits, edits.where("seq % 10 = 0").groupBy("session").agg(F.max("seq").alias("seq")))


@query("SELECT session, seq FROM (SELECT user_id AS session, event_id AS seq, sum(1000 + event_id % 5000) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS used FROM events) WHERE used <= 60000")
def checkpoint_export(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (1000 + F.col("event_id") % 5000).alias("size"))
    return ledger.exported(rows, 60_000).select("session", "seq")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(CAST(role = 'user' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS u FROM conversations) WHERE u <= conv_id % 3 + 1")
def truncate_to_turn(spark, sf_dir):
    messages = table(spark, sf_dir, "conversations")
    return logs.up_to_turn(messages, messages.select("conv_id", (F.col("conv_id") % 3 + 1).alias("last")).distinct()).select("conv_id", "turn")


@query("""WITH m AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN list_filter(['c' || (turn - 1), 'c' || (turn + 1)], lambda x: true) END AS calls, CASE WHEN role = 'user' AND turn > 0 THEN 'c' || turn END AS answers FROM conversations),
called AS (SELECT DISTINCT conv_id, unnest(calls) AS c FROM m), t AS (SELECT * FROM m WHERE answers IS NULL OR EXISTS (SELECT 1 FROM called WHERE called.conv_id = m.conv_id AND c = answers)),
g AS (SELECT conv_id, list(answers) AS given FROM t WHERE answers IS NOT NULL GROUP BY conv_id)
SELECT t.conv_id, turn, array_to_string(list_filter(calls, lambda c: list_contains(coalesce(given, []), c)), ',') AS calls FROM t LEFT JOIN g ON g.conv_id = t.conv_id""")
def orphan_repair(spark, sf_dir):
    """Users' later turns stand for tool answers; calls and answers without each other go."""
    rows = table(spark, sf_dir, "conversations")
    answers = F.when((F.col("role") == "user") & (F.col("turn") > 0), F.concat(F.lit("c"), F.col("turn").cast("string")))
    calls = F.when(F.col("role") == "assistant", F.array(F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")), F.concat(F.lit("c"), (F.col("turn") + 1).cast("string"))))
    messages = rows.select("conv_id", "turn", F.when(answers.isNotNull(), "tool").otherwise(F.col("role")).alias("role"), calls.alias("calls"), answers.alias("answers"))
    return logs.without_orphans(messages).select("conv_id", "turn", F.array_join("calls", ",").alias("calls"))


@query("""WITH r AS (SELECT conv_id AS query_id, turn, CASE role WHEN 'user' THEN 'preference' ELSE 'fact' END AS kind, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations),
l AS (SELECT *, '- [' || kind || '] ' || text || chr(10) AS line FROM r), u AS (SELECT *, sum(length(line)) OVER (PARTITION BY query_id ORDER BY place) + length(h) AS used, h FROM l, (SELECT '## Remembered Context (from prior sessions — may be stale; verify against the current code before relying on it)' || chr(10) AS h))
SELECT query_id, max(h) || coalesce(string_agg(line, '' ORDER BY place) FILTER (used <= 600), '') AS text FROM u GROUP BY query_id""")
def memory_prompt(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    notes = rows.select(F.col("conv_id").alias("query_id"), place.alias("place"), F.when(F.col("role") == "user", "preference").otherwise("fact").alias("kind"), F.col("text").alias("content"))
    return memory.prompt(notes, 600)


@query("""WITH a AS (SELECT event_id AS seq, 'm' || event_id AS id, event_type || ' ' || (event_id % 700) AS content, CASE WHEN event_id % 4 = 0 THEN 'm' || (event_id - 3) END AS supersedes FROM events WHERE event_id % 5 > 1),
f AS (SELECT event_id AS seq, 'm' || (event_id - 2) AS id FROM events WHERE event_id % 5 = 0), v AS (SELECT 'm' || (event_id - 4) AS id, event_id AS seq, (event_id % 9) - 3.0 AS r FROM events WHERE event_id % 5 = 1),
dead AS (SELECT a.id FROM a JOIN (SELECT id, seq FROM f UNION ALL SELECT supersedes, seq FROM a WHERE supersedes IS NOT NULL) g ON g.id = a.id AND g.seq > a.seq UNION SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY lower(trim(content)) ORDER BY seq DESC) AS n FROM a) WHERE n > 1)
SELECT id, content, least(greatest(coalesce((SELECT max_by(r, v.seq) FROM v WHERE v.id = a.id), 1.0), 0.0), 2.0) AS relevance FROM a WHERE id NOT IN (SELECT id FROM dead)""")
def memory_crud(spark, sf_dir):
    """A log of notes added, superseded, forgotten and weighed."""
    key = F.col("event_id")
    rows = table(spark, sf_dir, "events")
    named = lambda c: F.concat(F.lit("m"), c.cast("string"))
    op = F.when(key % 5 == 0, "forget").when(key % 5 == 1, "relevance").otherwise("add")
    about = F.when(key % 5 == 0, named(key - 2)).when(key % 5 == 1, named(key - 4)).otherwise(named(key))
    log = rows.select(key.alias("seq"), op.alias("op"), about.alias("id"), F.concat_ws(" ", "event_type", (key % 700).cast("string")).alias("content"), F.when((key % 5 > 1) & (key % 4 == 0), named(key - 3)).alias("supersedes"), F.when(key % 5 == 1, (key % 9 - 3).cast("double")).alias("relevance"))
    return memory.live(log).select("id", "content", "relevance")


