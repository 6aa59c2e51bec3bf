"""Embedding with a cache and in windows, evaluation runs, failing rerankers, and diffs of long texts."""

import json
import os
import random
import re
import resource
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.operators import diff, evaluation, logs, retrieval, review
from spindrift.operators.cache import EmbedCache
from spindrift.operators.retrieval import Options, retrieve
from spindrift.operators.store import Store
from spindrift.plans import catalog
from spindrift.sources import files
from spindrift.streaming import changes


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_a_second_update_embeds_changed_texts_only(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def counting(texts: pd.Series) -> pd.Series:
        seen.add(len(texts))
        return pd.Series([[float(len(t)), 1.0] for t in texts])

    cache, store = EmbedCache(spark, str(tmp_path / "c")), Store(spark, str(tmp_path / "s"), model="org/m", dim=2)
    state = lambda rows: frame(spark, rows, "path string, contents string").withColumn("hash", F.sha2("contents", 256))
    cut = lambda d: d.select("path", "contents")
    first = [(f"f{k}", f"text {'x' * k}") for k in range(20)] + [("copy", "text x")]
    store.update(state(first), cut, embed=counting, cache=cache)
    assert seen.value == 20
    second = [(p, c + " more" if p in ("f3", "f4") else c) for p, c in first if p != "f9"] + [("back", "text " + "x" * 9)]
    store.update(state(second), cut, embed=counting, cache=cache)
    assert seen.value == 22
    assert {r["path"]: r["embedding"][0] for r in store.vectors().collect()} == {p: float(len(c)) for p, c in second}
    other = Store(spark, str(tmp_path / "t"), model="org/m", dim=2)
    other.update(state(second), cut, embed=counting, cache=cache)
    assert seen.value == 22
    cache.put("org/m", 2, frame(spark, [("aa", [1.0, 2.0])], "hash string, embedding array<float>"))
    cache.put("org/m", 2, frame(spark, [("aa", [9.0, 9.0]), ("bb", [3.0, 4.0, 5.0])], "hash string, embedding array<float>"))
    asked = frame(spark, [("aa",), ("bb",), ("cc",)], "hash string")
    assert [tuple(r) for r in cache.get("org/m", 2, asked).collect()] == [("aa", [1.0, 2.0])] and cache.get("org/m", 3, asked).count() == 0


def test_windows_read_their_own_files_and_break(spark):
    paths = frame(spark, [(f"p{n}", "x") for n in range(60)], "path string, contents string")
    plans, done = [], []

    def store_window(part):
        plans.append(part._jdf.queryExecution().executedPlan().toString())
        done.extend(r["path"] for r in part.collect())

    told = retrieval.embed_in_windows(paths, store_window, window=20)
    assert sorted(done) == sorted(f"p{n}" for n in range(60)) and {r["status"] for r in told.collect()} == {"stored"}
    assert all("PartitionFilters: [isnotnull(_window" in p for p in plans)
    with pytest.raises(retrieval.BreakerOpen, match="no answer"):
        retrieval.embed_in_windows(paths, lambda _: (_ for _ in ()).throw(OSError("no answer")), window=5, strict=True)


def test_a_run_isolates_cases_that_fail(spark):
    cases = frame(spark, [(k, f"q{k}") for k in range(40)], "item_id long, text string")
    gold = frame(spark, [(k, 10 * k) for k in range(40)] + [(0, 1)], "item_id long, doc_id long")
    calls, through = [], []

    def search(some):
        ids = {r["item_id"] for r in some.collect()}
        calls.append(len(ids))
        if ids & {7, 31}:
            raise ValueError("cannot answer\nat all")
        return some.select("item_id", (F.col("item_id") * 10).alias("doc_id"), F.lit(2).alias("rank"))

    rows = {r["item_id"]: r for r in evaluation.run(search, cases, gold, 10, on_part=lambda part, error: through.append((part.count(), error))).collect()}
    assert len(rows) == 40 and {k for k, r in rows.items() if r["error"]} == {7, 31} and rows[7]["error"] == "cannot answer"
    assert rows[7]["recall"] == 0 and rows[5]["rr"] == 0.5 and rows[0]["recall"] == 0.5 and all(r["elapsed_ms"] > 0 for r in rows.values())
    assert len(calls) < 40 and sum(n for n, _ in through) == 40
    total = evaluation.aggregate(evaluation.run(search, cases.where("item_id in (7, 8)"), gold)).first()
    assert total["cases"] == 2 and total["mrr"] == 0.25
    assert evaluation.run(search, cases.limit(0), gold).count() == 0


def test_a_reranker_that_fails_costs_the_reranking_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.add(frame(spark, [("a", "open door"), ("b", "open open door window")], "path string, contents string"))

    @F.pandas_udf(T.DoubleType())
    def broken(query: pd.Series, document: pd.Series) -> pd.Series:
        raise RuntimeError("model is gone")

    asked, failures = frame(spark, [(1, "open")], "query_id int, text string"), []
    found = retrieve(store, asked, Options(rerank=broken, on_failure=lambda name, e: failures.append((name, "model is gone" in str(e)))))["results"].orderBy("rank").collect()
    plain = retrieve(store, asked, Options())["results"].orderBy("rank").collect()
    assert [r["rowid"] for r in found] == [r["rowid"] for r in plain] and failures == [("reranked", True)]


def applied(old, steps):
    """The new text of a script, and whether the old one is what it takes."""
    return [line for sign, line in steps if sign != "+"] == old, [line for sign, line in steps if sign != "-"]


def test_long_diffs_are_shortest_in_linear_space(monkeypatch):
    rng = random.Random(5)
    for _ in range(150):
        a = [rng.choice("abcdef") for _ in range(rng.randint(0, 40))]
        b = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))]
        want = diff.script(a, b)
        for edits in (2000, 3):
            with monkeypatch.context() as m:
                m.setattr(diff, "MOST_CELLS", 12)
                m.setattr(diff.few_edits, "__defaults__", (edits,))
                got = diff.script(a, b)
            assert applied(a, got) == (True, b) and len(got) == len(want)
    lines = [f"line {rng.randrange(40_000)}" for _ in range(100_000)]
    changed = list(lines)
    for _ in range(300):
        at = rng.randrange(len(changed))
        changed[at : at + rng.randrange(3)] = [f"line {rng.randrange(40_000)}"] * rng.randrange(3)
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.perf_counter()
    steps = diff.script(lines, changed)
    assert applied(lines, steps) == (True, changed) and sum(s != " " for s, _ in steps) < 1500
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000 and time.perf_counter() - began < 60
    assert np.array_equal(diff.best_row(np.array([1, 2, 3]), np.array([2, 3, 1])), [0, 1, 2, 2])


def test_audit_sink_goes_on_behind_a_torn_line(spark, tmp_path):
    path = str(tmp_path / "audit.jsonl")
    files.AuditSink(path).log("run-start", "2024-01-01T00:00:00Z", note="n" * 1000)
    with open(path, "a") as file:
        file.write('{"seq": 2, "ts": "' + "x" * 200_000)
    sink = files.AuditSink(path)
    assert sink.seq == 1 and sink.log("run-end", "2024-01-01T00:00:01Z")["seq"] == 2
    assert files.AuditSink(path).log("tool-call", "2024-01-01T00:00:02Z")["seq"] == 3
    log = files.audit_log(spark, path)
    assert [r["seq"] for r in log.orderBy("seq").collect()] == [1, 2, 3] and logs.chained_breaks(log).count() == 0


def test_a_live_index_waits_until_a_path_is_quiet(spark, tmp_path):
    """Stated times: a's changes follow one another, b's is alone; each path is flushed once, when the watermark has passed its pause."""
    store = Store(spark, str(tmp_path / "s"), buckets=1)
    (tmp_path / "in").mkdir()
    state = lambda rows: spark.createDataFrame(rows, "path string, contents string").withColumn("hash", F.sha2("contents", 256))
    batches = [[(1, "a", "change", "00:00:00"), (2, "a", "unlink", "00:00:01"), (3, "b", "change", "00:00:01")], [(4, "a", "change", "00:00:02")], [(5, "z", "change", "00:05:00")], [(6, "z", "change", "00:09:00")]]
    for n, rows in enumerate(batches):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"seq": s, "path": p, "op": o, "ts": f"2024-01-01T{t}Z"}) for s, p, o, t in rows))
        os.utime(tmp_path / "in" / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    flushed = []

    def read(wanted):
        paths = sorted(r["path"] for r in wanted.collect())
        flushed.append(paths)
        return state([(p, f"{p} now") for p in paths])

    query = changes.live_index(store, state([("a", "first")]), changes.change_stream(spark, str(tmp_path / "in"), 1), read, lambda f: f.select("path", "contents"), str(tmp_path / "c"), quiet="1500 milliseconds", late="10 seconds").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert [p for paths in flushed for p in paths if p != "z"] == ["a", "b"] and ["a", "b"] in flushed
    fresh = Store(spark, str(tmp_path / "s"))
    assert {r["path"]: r["contents"] for r in fresh.chunks().collect()}["a"] == "a now"


def folded(text):
    """Files of a unified diff with their hunks' added lines, line by line."""
    files, number = [], 0
    for line in (text or "").split("\n"):
        if re.match(r"\+\+\+ b/.", line):
            files.append((line[6:], []))
        elif files and (head := re.match(r"@@ -\d+(?:,\d+)? \+(\d+)", line)):
            number = int(head[1])
            files[-1][1].append((number, []))
        elif files and files[-1][1] and not line.startswith("-"):
            if line.startswith("+"):
                files[-1][1][-1][1].append(f"L{number}: {line[1:]}")
            number += 1
    return [(path, hunks) for path, hunks in files if any(lines for _, lines in hunks)]


def test_changed_files_equal_a_reader_line_by_line(spark):
    rng = random.Random(3)
    parts = ["+++ b/src/a.ts", "--- a/src/a.ts", "+++ b/é x.py", "+++ c/odd", "@@ -1,2 +3,4 @@ head", "@@ -7 +9 @@", "@@ broken", "+added", "+", "-gone", " same", "", "diff --git a/x b/x", "\\ No newline at end of file", "+++ b/", "+\ttab\r", "--- gone dashes"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)] + [None, "", "no diff", "+++ b/only/head", "+++ b/x\n@@ -1 +1 @@", "@@ -1 +1 @@\n+early"]
    got = frame(spark, list(enumerate(texts)), "n int, diff string").select("n", review.changed_files(F.col("diff")).alias("files")).collect()
    assert len(got) == len(texts) and sum(len(r["files"]) for r in got) > 100
    for r in got:
        assert [(f["path"], [(h["new_start"], list(h["lines"])) for h in f["hunks"]]) for f in r["files"]] == folded(texts[r["n"]]), texts[r["n"]]


def test_review_queries_show_so_much_of_a_diff(spark):
    text = "--- a/big\n+++ b/big\n@@ -0,0 +5,50 @@\n" + "".join(f"+row {n}\n" for n in range(50)) + "+++ b/wide\n@@ -1 +1 @@\n+" + "é" * 9000 + "\n"
    rows = frame(spark, [(text, ["new.ts"], []), (None, None, None)], "diff string, new array<string>, old array<string>")
    full, none = [r["q"] for r in rows.select(review.review_query(F.col("diff"), F.col("new"), F.col("old")).alias("q")).collect()]
    assert "L44: row 39\n" in full and "row 40" not in full and "Deleted files" not in full and full.count("New files (not shown below — read them): new.ts") == 1
    assert len(full[full.index("File: wide") :]) == 6000 and none == f"{review.ASK}\n\n{review.ADVICE}\n"
    short = rows.select(review.review_query(F.col("diff"), chars_a_file=100).alias("q")).first()["q"]
    assert "File: big" in short and len(short[short.index("File: wide") :]) == 100


def test_near_makes_no_pairs_of_a_long_file(spark):
    """Chunks of one file and some others against all pairs, overlapping ones and repeated rowids among them; no join is left in the plan."""
    import random

    from spindrift.operators import lexical

    rng = random.Random(3)
    rows = [(rng.randrange(300), "long" if rng.random() < 0.8 else f"f{k % 5}", start, start + rng.randrange(60)) for k in range(400) for start in [rng.randrange(900)]]
    table = spark.createDataFrame(rows, "rowid long, path string, start_line int, end_line int")
    found = lexical.near(table, table)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    pairs: dict[int, list] = {}
    for a, path, start, end in rows:
        pairs.setdefault(a, []).extend((start - e if e < start else s - end, r) for r, p, s, e in rows if p == path and r != a)
    want = {a: sorted(x)[:4] for a, x in pairs.items() if x}
    got: dict[int, list] = {}
    for r in found.orderBy("anchor", "rank").collect():
        got.setdefault(r["anchor"], []).append((r["gap"], r["rowid"]))
    assert got == want


def test_copies_of_notes_are_compared_once(spark, monkeypatch):
    """200 copies of each note on either side: as many sets are compared as there are different ones that the other side has not."""
    from spindrift.operators import memory

    known = ["the build uses gradle and kotlin today", "never deploy on fridays please"]
    new = ["kotlin and gradle the build uses today", "the build uses gradle and kotlin daily", "nothing of the sort was said here"]
    rows = lambda texts, first: spark.createDataFrame([(first + 1000 * k + n, x) for k, x in enumerate(texts) for n in range(200)], "id long, content string")
    seen, inner = [], memory.overlap_candidates
    monkeypatch.setattr(memory, "overlap_candidates", lambda a, b, least: seen.append((a.count(), b.count())) or inner(a, b, least))
    left = memory.not_paraphrased(rows(new, 0), rows(known, 100_000))
    assert sorted(r["id"] for r in left.collect()) == [2000 + n for n in range(200)]
    assert seen == [(2, 2)]


def test_few_rows_of_a_batch_are_held_as_texts():
    """Diffs and counted identifiers take Arrow columns in pieces; order, nulls and the pieces' ends are kept."""
    import pyarrow as pa

    from spindrift.functions import text as X

    old = [None if k % 7 == 0 else f"a\nb{k}" for k in range(600)]
    new = [f"a\nc{k}" for k in range(600)]
    assert diff.unified_diff.func(pa.array(old), pa.array(new)).to_pylist() == [diff.unified(x or "", y) for x, y in zip(old, new, strict=True)]
    tokens = [None if k % 5 == 0 else [f"t{k}", "x", "x"] for k in range(600)]
    want = [None if t is None else [{"identifier": "x", "times": 2}, {"identifier": t[0], "times": 1}] for t in tokens]
    assert X._counted.func(pa.array(tokens, pa.list_(pa.string()))).to_pylist() == want


def test_indexed_paths_equal_sql_on_odd_rows(spark, tmp_path):
    texts = ["", None, " ", "\n", "open door", "", "...", "open door"]
    rows = [(k, t, "en", None if k == 4 else f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(catalog.ORACLES["indexed_paths"]).fetchall()
    assert [tuple(r) for r in catalog.QUERIES["indexed_paths"](spark, str(tmp_path)).collect()] == want and len(want) == 5


def test_notes_with_rare_words_in_common_are_not_paired(spark):
    """Sets whose rare words many others hold: hardly more pairs leave the join than are alike, and none that is alike is lost."""
    from spindrift.operators import memory

    rng = random.Random(11)
    sets = {n: {f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 12, 40, 150]))} for n in range(300)}
    sets |= {n + 300: {w for w in sets[n] if rng.random() < 0.9} | {f"w{rng.randrange(300)}"} for n in range(60)}
    rows = spark.createDataFrame([(n, sorted(w)) for n, w in sets.items()], "id long, w array<string>")
    alike = {(a, b) for a, x in sets.items() if a % 3 for b, y in sets.items() if b % 3 == 0 and len(x & y) >= 0.8 * min(len(x), len(y))}
    found = {(r["a"], r["b"]) for r in memory.overlap_candidates(rows.where("id % 3 != 0"), rows.where("id % 3 = 0"), 0.8).collect()}
    assert alike <= found and 20 < len(alike) and len(found) < 3 * len(alike)


def test_a_note_like_very_many_is_compared_with_few_of_them(spark, monkeypatch):
    """Where the first known set that a note may be like does not settle it, the others do."""
    from spindrift.operators import memory

    words = lambda name, n: [f"{name}{k}" for k in range(n)]
    text = lambda n, *parts: (n, " ".join(sum(parts, [])))
    known = [text(n, words("word", 32), words(f"own{n}x", 8)) for n in range(100)]
    # two notes are each like one known note, and lack one word to be like another
    ours = [text(1000, words("word", 40)), text(1001, words("word", 28), words("fresh", 12))]
    ours += [text(1002 + k, words("word", 26), words(f"own{like}x", 8), words(f"own{other}x", 5), ["last"]) for k, (like, other) in enumerate([(3, 57), (57, 3)])]
    sizes, inner = [], memory.fs.kept
    monkeypatch.setattr(memory.fs, "kept", lambda d: [x := inner(d), sizes.append((tuple(x.columns), x.count()))][0])
    monkeypatch.setattr(memory, "SIGNED", 1)  # so few bits let pairs through that are not alike
    left = memory.not_paraphrased(frame(spark, ours, "id long, content string"), frame(spark, known, "id long, content string"))
    assert [r["id"] for r in left.collect()] == [1001]
    assert [n for columns, n in sizes if columns == ("a", "b")] == [104, 3]


@F.pandas_udf(T.DoubleType())
def _gone(query: pd.Series, document: pd.Series) -> pd.Series:
    raise RuntimeError("model is gone")


def test_a_failed_reranker_is_not_taken_for_a_result(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.add(frame(spark, [("a", "open door"), ("b", "open open door window")], "path string, contents string"))
    asked, seen, told = frame(spark, [(1, "open")], "query_id int, text string"), [], []
    with pytest.raises(Exception, match="model is gone"):
        retrieve(store, asked, Options(rerank=_gone))
    found = retrieve(store, asked, Options(rerank=_gone, on_stage=lambda name, rows: seen.append(name), on_failure=lambda name, error: told.append(name)))
    assert told == ["reranked"] and "reranked" not in found and "reranked" not in seen
    assert [r["rerank_score"] for r in found["results"].collect()] == [None, None]

    def closed(name, rows):
        if name == "reranked":
            raise OSError("the consumer is gone")

    with pytest.raises(OSError, match="consumer"):  # a consumer's failure is not the reranker's
        retrieve(store, asked, Options(rerank=retrieval.overlap_reranker, on_stage=closed, on_failure=lambda name, error: told.append(error)))
    assert told == ["reranked"]


@pytest.mark.parametrize("name", ["retrieve_full", "retrieval_summary"])
def test_search_queries_fail_with_their_reranker(spark, tmp_path, monkeypatch, name):
    rows = [(k, f"get the list {k}", "en", "s", 14) for k in range(5)]
    frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(retrieval, "overlap_reranker", _gone)
    with pytest.raises(Exception, match="model is gone"):
        catalog.QUERIES[name](spark, str(tmp_path)).collect()
