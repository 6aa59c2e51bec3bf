"""Operators against independent engines and stated values."""

import json
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from spindrift.functions import stem
from spindrift.functions import text as X
from spindrift.operators import chunking, diff, graph, ledger, lexical, logs, memory, packing, policy, ranking, retrieval, symbols
from spindrift.operators.store import Store
from spindrift.sources import files
from spindrift.streaming import changes

CORPUS = [
    (1, "src/auth.ts", "openSession", "function openSession() { return session; } // sessions are opened"), (2, "src/über.py", "parse", "über parse chunks and chunk_size of a chunk"), (3, "docs/read_me.md", None, "The after_this_request hook; after request"),
    (4, "src/session.ts", "Session", "class Session { close() {} }"), (5, "lib/x.go", None, ""), (6, "src/auth/session.ts", "closeSession", "session session session"),
]


def columns(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_bm25_equals_fts5(spark):
    """Without stemming on either side; scores, phrases and column weights."""
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(path, symbol, contents, tokenize='unicode61 remove_diacritics 0')")
    db.executemany("INSERT INTO f(rowid, path, symbol, contents) VALUES (?, ?, ?, ?)", CORPUS)
    chunks = columns(spark, CORPUS, "rowid long, path string, symbol string, contents string")
    asked = {1: "session opened", 2: "after_this_request chunk", 3: "über x", 4: "ZZ!", 5: "src session chunk_size"}
    got = lexical.bm25(chunks, columns(spark, [*asked.items()], "query_id int, text string"), 10).collect()
    for number, text in asked.items():
        terms = list(dict.fromkeys(re.findall("[a-z0-9_]{2,}", text.lower())))[:16]
        want = {}
        if terms:
            want = dict(db.execute("SELECT rowid, -bm25(f, 5.0, 6.0, 1.0) FROM f WHERE f MATCH ?", [" OR ".join(f'"{t}"' for t in terms)]).fetchall())
        have = {r["rowid"]: r["score"] for r in got if r["query_id"] == number}
        assert have.keys() == want.keys() and all(abs(have[k] - want[k]) < 1e-9 for k in want), (text, have, want)


def test_stemmer_equals_fts5():
    words = "chunks chunk running relational conditional rational valenci digitizer conformabli radicalli differentli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption communism activate angulariti homologous effective bowdlerize probate rate cease controll roll hopping tanned falling hissing fizzed failing filing happy sky caresses ponies ties cats feed agreed plastered bled motoring sing conflated troubled sized".split()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='porter unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, row)")
    for w in words:
        db.execute("DELETE FROM f")
        db.execute("INSERT INTO f(t) VALUES (?)", [w])
        assert db.execute("SELECT term FROM v").fetchone()[0] == stem.stem(w), w


def test_fusion_weights_and_ties(spark):
    schema = "query_id int, rowid long, rank int, score double"
    a, b = columns(spark, [(1, 1, 1, 0.9), (1, 2, 2, 0.8), (1, 3, 3, 0.7)], schema), columns(spark, [(1, 3, 1, 5.0), (1, 1, 2, 4.0), (1, 4, 3, 3.0)], schema)
    even = ranking.fuse([a, b], [1.0, 1.0], 10).orderBy("rank").collect()
    assert {r["rowid"] for r in even[:2]} == {1, 3} and even[0]["score_0"] == 0.9 and even[0]["score_1"] == 4.0
    assert ranking.fuse([a.where("rowid < 3"), columns(spark, [(1, 2, 1, 1.0), (1, 1, 2, 1.0)], schema)], [1.0, 10.0], 1).first()["rowid"] == 2


@pytest.mark.parametrize(("text", "shape"), [("getUserData", "definition"), ("Flask", "intent"), ("how does the auth middleware work", "intent"), ("Flask Werkzeug", "definition"), ("src/auth.ts", "definition"), ("make_response", "definition"), ("where are users stored", "intent"), ("sha256 digest", "definition")])
def test_query_shape(spark, text, shape):
    assert columns(spark, [(text,)], "q string").select(X.query_shape(F.col("q"))["shape"]).first()[0] == shape


def test_chunker():
    lines = [f"line {k}" for k in range(1, 201)]
    lines[99] = "def here():"
    spans = chunking.spans_of(lines, 80, 15)
    assert spans == [[1, 80], [66, 99], [100, 179], [165, 200]]
    assert chunking.spans_of(["a", "def x():", "b", "def y():"], 80, 15) == [[1, 4]]
    assert [p[:2] for p in chunking.by_characters(["aaaa", "bbbb", "c" * 30, "d"], 5, 10)] == [(5, 6), (7, 7), (8, 8)]


def test_edges_of_source_files(spark):
    rows = [
        ("src/main.ts", 'import { a as b, c } from "./utils";\nimport D from "../lib/d";\nconst x = require("./y");\nexport class Foo extends Bar implements Baz {}\nb(); other();', "typescript"),
        ("pkg/m.py", "from .base import Thing as T, other\nimport os.path\nclass A(Base, object):\n  pass", "python"), ("m.go", 'import (\n  "fmt"\n  x "net/http"\n)', "go"),
        ("m.rs", "use crate::a::b::{C, D};\nimpl Show for Item {}", "rust"), ("M.java", "import java.util.List;\nclass A extends B implements C, D<E> {}", "java"), ("M.cs", "using System.Text;\nclass A : Base, IThing {}", "c_sharp"),
    ]
    found = {(r["source_path"], r["source_symbol"], r["target_path"], r["target_symbol"], r["kind"]) for r in graph.source_edges(columns(spark, rows, "path string, contents string, language string")).collect()}
    for edge in [
        ("src/main.ts", "b", "src/utils", "a", "imports"), ("src/main.ts", "D", "lib/d", "default", "imports"), ("src/main.ts", None, "src/y", None, "imports"), ("src/main.ts", "Foo", "src/main.ts", "Bar", "extends"), ("src/main.ts", None, "src/utils", "a", "calls"),
        ("pkg/m.py", "Thing", "pkg/base", "Thing", "imports"), ("pkg/m.py", None, "os/path", None, "imports"), ("pkg/m.py", "A", "pkg/m.py", "Base", "extends"), ("m.go", None, "net/http", None, "imports"), ("m.rs", "D", "crate/a/b", "D", "imports"),
        ("m.rs", "Item", "m.rs", "Show", "implements"), ("M.java", "A", "M.java", "D", "implements"), ("M.cs", "A", "M.cs", "IThing", "implements"),
    ]:
        assert edge in found, edge


def test_packing_stays_in_budget(spark):
    rows = [(1, k, f"f{k % 3}", k * 20, k * 20 + 4, "\n".join(f"text {n}" for n in range(5)), 10.0 - k, "Thing") for k in range(12)]
    out = packing.pack(columns(spark, rows, "query_id long, rank int, path string, start_line int, end_line int, contents string, score double, symbol string"), 900, 400, 2, 3).first()
    assert out["output"].startswith("Relevant context (packed): ") and out["chars"] == len(out["output"]) <= 1100 and "Symbols: Thing" in out["output"]


def test_packing_query_sees_all_documents(spark):
    from spindrift.plans import index

    folder = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{folder}/documents.parquet").where("text != ''")
    assert {r["query_id"] for r in index.pack_budget(spark, folder).collect()} == {r["doc_id"] // 100 for r in documents.select("doc_id").collect()}
    assert {r["n"] for r in index.result_rows(spark, folder).select("n").distinct().collect()} == {r["doc_id"] for r in documents.select("doc_id").collect()}


def test_audit_chain(spark):
    from hashlib import sha256

    rows, before = [], ""
    for seq in range(1, 8):
        own = sha256("|".join([str(seq), "t", "run", "{}", before]).encode()).hexdigest()
        rows.append((seq, "t", "run", "{}", before, own))
        before = own
    schema = "seq long, ts string, type string, data string, prev string, hash string"
    broken = lambda r: [tuple(x) for x in logs.chained_breaks(columns(spark, r, schema), 3).collect()]
    assert broken(rows) == []
    assert broken(rows[:3] + rows[4:]) == [(5, "gap")]
    assert broken([r if r[0] != 4 else (*r[:3], "{1}", *r[4:]) for r in rows]) == [(4, "hash")]
    assert broken([r if r[0] != 6 else (*r[:4], "x", r[5]) for r in rows]) == [(6, "link")]


def test_paraphrases_equal_brute_force_without_all_pairs(spark):
    import random

    rng = random.Random(4)
    notes = {n: {"the", *(f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 14)))} for n in range(300)}
    notes |= {n + 300: {w for w in notes[n] if rng.random() < 0.9} | {f"z{n}"} for n in range(100)} | {400: set(), 401: {"the"}, 402: {f"w{k}" for k in range(4)}, 403: {f"w{k}" for k in range(5)}}
    rows = spark.createDataFrame([(n, " ".join(sorted(w))) for n, w in notes.items()], "id long, content string")
    ours, theirs = rows.where("id % 2 = 1 or id >= 350"), rows.where("id % 2 = 0 and id < 350")
    split = lambda d: {r["id"]: set(r["content"].split()) & {w for w in r["content"].split() if len(w) > 2} for r in d.collect()}
    a, b = split(ours), split(theirs)
    texts = {r["content"] for r in theirs.collect()}
    expected = {n for n, x in a.items() if " ".join(sorted(notes[n])) not in texts and not any(x and y and len(x & y) >= 0.8 * min(len(x), len(y)) for y in b.values())}
    assert 0 < len(expected) < len(a) and {r["id"] for r in memory.not_paraphrased(ours, theirs).collect()} == expected
    sets = lambda d: d.selectExpr("id", "split(content, ' ') as w").where("content != '' and id != 401")
    assert memory.overlap_candidates(sets(ours), sets(theirs), 0.8).count() < len(a) * len(b) / 4


def test_harvest(spark):
    texts = [(1, "I found that the loader lives in src/core/loader.ts today. Fine."), (2, "I doubt the project uses a very large database of things."), (3, "```the system uses a very large cache of things```"), (4, "The system uses token: abcdefghijklmnop for access.")]
    out = [tuple(r) for r in memory.harvest(columns(spark, texts, "id long, text string"), memory.ANSWER_FACTS).collect()]
    assert out == [(1, "the loader lives in src/core/loader.ts today")]


def test_diff_lines(spark):
    diff = "diff --git a/x b/x\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +10,3 @@\n keep\n+new\n-old\n keep\n+more"
    out = [(r["path"], r["line"], r["text"]) for r in logs.diff_lines(columns(spark, [(1, diff)], "id long, diff string")).orderBy("line").collect()]
    assert out == [("x.py", 11, "new"), ("x.py", 13, "more")]


TREE = {
    "src/a.py": b"x = 1", "src/__init__.py": b"from .a import x", "src/_private.py": b"p", ".github/workflows/ci.yml": b"on: push", ".eslintrc.js": b"e", ".hidden/x.py": b"h", "node_modules/m.js": b"z",
    "conf/credentials": b"K=1", "src/bin.py": b"a\x00b", "src/gen/b.py": b"y", "src/gen/keep.py": b"k", ".gitignore": b"*.log\n/out2/\n# note\ntmp/\n", "src/x.log": b"l", "src/sub/.gitignore": b"!x.log\n*.txt\n", "src/sub/x.log": b"l", "src/sub/t.txt": b"t",
    "src/t.txt": b"t", "out2/a.py": b"o", "src/out2/a.py": b"o", "src/tmp/deep/a.py": b"t", ".git/info/exclude": b"*.bak\n", "src/a.bak": b"b", "ctx/skip.py": b"s", ".contextignore": b"ctx/\n", "pinned/a.py": b"p", "big.py": b"x" * ((1 << 20) + 1),
}


def test_scan_of_a_folder(spark, tmp_path):
    """Hidden names, nested ignore files with negation, folders that are not entered, and the reasons."""
    for name, body in TREE.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    scanned = files.scan(spark, str(tmp_path), ["src/gen/*", "!src/gen/keep.py"], ["pinned/"])
    assert {r["path"]: r["reason"] for r in scanned.collect()} == {
        "src/a.py": None, "src/__init__.py": None, "src/_private.py": None, ".github/workflows/ci.yml": None, ".eslintrc.js": None, ".hidden/": "folder", "node_modules/": "folder", "conf/credentials": "credential", "src/bin.py": None,
        "src/gen/b.py": "contextignore", "src/gen/keep.py": None, ".gitignore": None, "src/x.log": "ignored", "src/sub/.gitignore": None, "src/sub/x.log": None, "src/sub/t.txt": "ignored", "src/t.txt": None, "out2/": "ignored", "src/out2/a.py": None,
        "src/tmp/": "ignored", ".git/": "folder", "src/a.bak": "ignored", "ctx/": "contextignore", ".contextignore": None, "pinned/": "policy", "big.py": "size",
    }
    stats = {r["reason"]: (r["files"], r["examples"]) for r in files.statistics(scanned, 2).collect()}
    assert stats["ignored"] == (5, ["out2/", "src/a.bak"]) and stats["size"] == (1, ["big.py"])
    texts = {r["path"]: (r["contents"], r["language"]) for r in files.read(spark, str(tmp_path), ["src/gen/*", "!src/gen/keep.py"], ["pinned/"]).collect()}
    assert texts["src/__init__.py"] == ("from .a import x", "python") and "src/bin.py" not in texts and len(texts) == 12
    with pytest.raises(FileNotFoundError):
        files.scan(spark, str(tmp_path / "nothing"))
    assert files.glob("*.log") == r"(^|/)[^/]*\.log(/.*)?$"


def test_audit_sink_goes_on_where_the_log_ends(spark, tmp_path):
    path = str(tmp_path / "log" / "audit.jsonl")
    sink = files.AuditSink(path, 10)
    sink.log("run-start", "2024-01-01T00:00:00Z", note="x" * 30)
    files.AuditSink(path).log("tool-call", "2024-01-01T00:00:01Z", n=1)
    files.AuditSink(path).log("run-end", "2024-01-01T00:00:02Z")
    with open(path, "a") as file:
        file.write('{"seq": 4, "ts"')
    log = files.audit_log(spark, path)
    assert [r["seq"] for r in files.audit_log(spark, path, last=2).collect()] == [2, 3] and [r["seq"] for r in files.audit_log(spark, path, kind="run-end", since="2024-01-01T00:00:02Z").collect()] == [3]
    assert "…[+20 chars]" in log.where("seq = 1").first()["data"] and logs.chained_breaks(log).count() == 0
    altered = log.withColumn("data", F.when(F.col("seq") == 2, "{}").otherwise(F.col("data")))
    assert tuple(logs.chained_breaks(altered).first()) == (2, "hash")


def test_json_stores_and_checked_files(spark, tmp_path):
    folder = str(tmp_path / "sessions")
    for name, at in (("a", 1), ("b", 3), ("c", 2)):
        files.save_json(spark, folder, name, {"id": name, "updated_at": at})
    assert files.remove_json(spark, folder, "c") and not files.remove_json(spark, folder, "c")
    assert [r["id"] for r in files.json_store(spark, folder, "id string, updated_at long").collect()] == ["b", "a"]
    (tmp_path / "GUIDE.md").write_text("intro\n# Python style\nuse it\n## Web [scope: *.ts, src/]\nmore\n")
    (tmp_path / "OTHER.md").write_text("# Alone\nx")
    rows = files.sections(spark, str(tmp_path / "*.md")).orderBy("file", "place").collect()
    assert [(r["place"], r["title"], r["scope"], r["content"]) for r in rows] == [(1, "Python style", ["*.py", "*.pyi"], "use it"), (2, "Web [scope: *.ts, src/]", ["*.ts", "src/"], "more"), (1, "Alone", [], "x")]
    (tmp_path / "AGENTS.md").write_text("y" * 20)
    assert files.instructions(spark, str(tmp_path), 10) == "y" * 10 + "\n\n[... AGENTS.md truncated at 10 chars]"
    assert [c["id"] for c in files.eval_cases('{"cases": [{"id": "1", "query": "q", "expected": ["a\\\\b"]}]}')] == ["1"]
    good = {"id": "t", "instruction": "do", "files": {"a/b": "x"}, "verify": {"command": "true"}}
    assert files.agent_tasks(json.dumps([good])) == [good]
    for path in ("/a", "../a", "C:\\x", "a/../../b"):
        with pytest.raises(ValueError, match="relative"):
            files.agent_tasks(json.dumps({"tasks": [good | {"files": {path: ""}}]}))
    assert files.settings([{"a": 1, "b": {"c": 1, "d": 2}}, {"b": {"c": 3}, "a": None}]) == {"a": 1, "b": {"c": 3, "d": 2}}
    rules = spark.createDataFrame(files.policy_rows([("org", '{"agent": {"shell": {"allowlist": ["ls", "git"], "maxTimeoutMs": 5}}, "ignore": ["x"]}'), ("own", '{"agent": {"edits": {"enabled": false}, "shell": {"allowlist": ["git"]}}, "ignore": ["y", "x"]}')]), policy.RULES)
    merged = policy.merged(rules)
    row = merged.withColumn("told", policy.described(merged)).first()
    assert (row["edits"], row["shell_allowed"], row["shell_ms"], row["ignore"], row["told"]) == (False, ["git"], 5, ["x", "y"], "edits: blocked; shell allowlist: [git]; 2 pinned ignore pattern(s)")
    log = spark.createDataFrame([("1700000000\n\na.py\nsrc/b.py\n\n1700086400\n\na.py\n",)], "log string")
    assert sorted((r["path"], int(r["ts"].timestamp())) for r in files.parsed_log(log).collect()) == [("a.py", 1700000000), ("a.py", 1700086400), ("src/b.py", 1700000000)]


def test_stored_index_equals_fts5_with_stemming(spark, tmp_path):
    """Scores and phrases over stemmed postings, after changes and compaction too."""
    rows = [*CORPUS, (7, "src/chunker.ts", "chunkFile", "splitting files into chunks; a chunk splits")]
    frame = columns(spark, rows, "rowid long, path string, symbol string, contents string").withColumn("parent", F.lit(None).cast("string"))
    store = Store(spark, str(tmp_path / "s"), stemmed=True, buckets=4)
    store.add(frame.where("rowid < 5"))
    store.add(columns(spark, [(20, "lib/x.go", None, "will be replaced"), (21, "gone.py", "chunk", "chunk chunk")], "rowid long, path string, symbol string, contents string").withColumn("parent", F.lit(None).cast("string")))
    store.add(frame.where("rowid > 4"), removed=columns(spark, [("gone.py",)], "path string"))
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(path, symbol, contents, tokenize='porter unicode61 remove_diacritics 0')")
    split = {r["rowid"]: r["s"] for r in frame.select("rowid", X.symbol_text(F.col("symbol"), F.col("parent")).alias("s")).collect()}
    db.executemany("INSERT INTO f(rowid, path, symbol, contents) VALUES (?, ?, ?, ?)", [(r, p, split[r], c) for r, p, _, c in rows])
    asked = {1: "chunk chunks splitting", 2: "opened session", 3: "after_this_request chunk_size", 4: "closing"}
    for reader in (store, Store(spark, str(tmp_path / "s"), stemmed=True), store.compact(str(tmp_path / "backup"))):
        got = reader.search(columns(spark, [*asked.items()], "query_id int, text string"), 10).collect()
        for number, text in asked.items():
            terms = list(dict.fromkeys(re.findall("[a-z0-9_]{2,}", text)))
            want = dict(db.execute("SELECT rowid, -bm25(f, 5.0, 6.0, 1.0) FROM f WHERE f MATCH ?", [" OR ".join(f'"{t}"' for t in terms)]).fetchall())
            have = {r["rowid"]: r["score"] for r in got if r["query_id"] == number}
            assert have.keys() == want.keys() and all(abs(have[k] - want[k]) < 1e-9 for k in want), (text, have, want)
    stale = Store(spark, str(tmp_path / "s"), model="other", dim=3, read_only=True)
    assert "model" in stale.stale_reason
    with pytest.raises(PermissionError):
        stale.set_meta(a="b")


def test_rowids_follow_path_and_line(spark, tmp_path):
    rows = [(f"p{n % 7}", n, n, f"text {n}") for n in range(60)]
    store = Store(spark, str(tmp_path / "s"))
    store.add(columns(spark, rows, "path string, start_line int, end_line int, contents string"))
    found = store.chunks().orderBy("rowid").select("path", "start_line", "rowid").collect()
    assert [(r["path"], r["start_line"]) for r in found] == sorted((p, n) for p, n, *_ in rows) and [r["rowid"] - found[0]["rowid"] for r in found] == [*range(60)]


FILES = [("src/a.ts", "open", 'import { help } from "./b";\nfunction open() { help(); }'), ("src/b.ts", "help", 'import { deep } from "./c";\nexport function help() {}'), ("src/c.ts", "deep", "export function deep() {}"), ("src/d.ts", "user", 'import { open } from "./a";\nopen();'), ("e.py", "other", "nothing here")]


def test_graph_extras_reach_the_second_hop(spark, tmp_path):
    chunks = columns(spark, [(n, p, s, None, 1, 2, c) for n, (p, s, c) in enumerate(FILES)], "rowid long, path string, symbol string, parent string, start_line int, end_line int, contents string")
    rows = [("src/a.ts", "help", "src/b.ts", "help", "imports", 1.0), ("src/a.ts", "open", "src/b.ts", "help", "calls", 0.7), ("src/b.ts", "help", "src/c.ts", "deep", "imports", 1.0), ("src/d.ts", "user", "src/a.ts", "open", "calls", 0.7), ("src/b.ts", "help", "src/zz.ts", "gone", "calls", 0.7)]
    edges = columns(spark, [(n, *r) for n, r in enumerate(rows)], "id long, source_path string, source_symbol string, target_path string, target_symbol string, kind string, confidence double")
    results = chunks.where("rowid = 0").withColumn("query_id", F.lit(1)).withColumn("rank", F.lit(1)).withColumn("score", F.lit(1.0))
    found = [(r["rowid"], round(r["score"], 6), r["reason"]) for r in graph.expand_chunks(results, graph.chunk_adjacency(edges, chunks)).orderBy("place").collect()]
    assert found == [(1, 0.385, "calls src/b.ts:help"), (3, 0.385, "src/d.ts:user calls this"), (2, round(0.385 * 0.55, 6), "imports src/c.ts:deep")]
    wanted = graph.imported_paths(chunks.select("rowid", "path", "contents"), chunks.select("path"))
    assert {(r["path"], r["target"]) for r in wanted.collect()} == {("src/a.ts", "src/b.ts"), ("src/b.ts", "src/c.ts"), ("src/d.ts", "src/a.ts")}
    imports = columns(spark, [(n, f"f{a}", f"f{b}", "imports") for n, (a, b) in enumerate([(0, 1), (0, 2), (1, 3), (3, 4), (2, 0), (9, 9)])], "id long, source_path string, target_path string, kind string")
    pages = columns(spark, [(n, f"f{n}", 1) for n in range(5)], "rowid long, path string, start_line int")
    asked = pages.where("rowid = 0").withColumn("query_id", F.lit(1)).withColumn("rank", F.lit(1)).withColumn("score", F.lit(1.0))
    assert [(r["rowid"], round(r["score"], 6)) for r in graph.dependency_chunks(asked, imports, pages).orderBy("place").collect()] == [(1, 0.4), (2, 0.4), (3, 0.12)]


def test_dependencies_are_packed_behind_results(spark):
    schema = "query_id long, rank int, path string, start_line int, end_line int, contents string, score double, symbol string"
    main, more = columns(spark, [(1, 1, "a", 1, 2, "x\ny", 2.0, "s"), (1, 2, "a", 2, 4, "y\nz\nw", 1.0, None)], schema), columns(spark, [(1, 1, "b", 1, 1, "dep", 0.4, None)], schema)
    row = packing.pack_with_dependencies(main, more, 4000).first()
    assert (row["files"], row["chunks"]) == (2, 3) and "**Dependencies (imported by above):**" in row["output"] and row["output"].index("## a") < row["output"].index("## b")
    assert [(d["lines"], d["action"]) for d in row["decisions"]] == [("2-4", "merged"), ("1-4", "included"), ("1-1", "included")]
    assert packing.pack_with_dependencies(main, more.limit(0), 4000).first()["files"] == 1


def test_python_edges_by_tree(spark):
    source = "import os.path as p\nfrom ..core import Base as B, make\nfrom .x import *\nclass A(B, mod.C):\n    def m(self):\n        make(1)\n        p.join()\ndef top():\n    pass\n"
    rows = columns(spark, [("pkg/sub/a.py", source, "python"), ("bad.py", "def (", "python"), ("m.go", 'import "fmt"', "go")], "path string, contents string, language string")
    found = {tuple(r)[1:] for r in symbols.all_edges(rows).where("source_path = 'pkg/sub/a.py'").collect()}
    assert found == {
        ("p", "os/path", None, "imports", 0.9), ("B", "pkg/core", "Base", "imports", 1.0), ("make", "pkg/core", "make", "imports", 1.0), (None, "pkg/sub/x", None, "imports", 0.7), ("A", "pkg/sub/a.py", "A", "exports", 1.0),
        ("A", "pkg/sub/a.py", "B", "extends", 0.85), ("A", "pkg/sub/a.py", "C", "extends", 0.85), ("top", "pkg/sub/a.py", "top", "exports", 1.0), (None, "pkg/core", "make", "calls", 0.75), (None, "os/path", None, "calls", 0.75),
    }
    assert {(r["source_path"], r["target_path"]) for r in symbols.all_edges(rows).where("source_path = 'm.go'").collect()} == {("m.go", "fmt")}


def test_unified_diffs_apply(tmp_path):
    """Diffs of random texts, applied by another program, give the new text."""
    import random
    import subprocess

    rng = random.Random(3)
    for turn in range(40):
        old = [rng.choice("abcdef") for _ in range(rng.randint(1, 40))]
        new = [x for x in old if rng.random() > 0.15]
        for _ in range(rng.randint(0, 4)):
            new.insert(rng.randint(0, len(new)), rng.choice("abcxyz"))
        if not new or old == new:
            continue
        target = tmp_path / f"f{turn}"
        target.write_text("\n".join(old) + "\n")
        done = subprocess.run(["patch", "-s", str(target)], input=diff.unified("\n".join(old), "\n".join(new)), text=True, capture_output=True)
        assert done.returncode == 0 and target.read_text() == "\n".join(new) + "\n", (old, new, done)
    assert diff.unified("a\nb", "a\nb") == "" and diff.unified("", "a") == "--- a\n+++ b\n@@ -1,0 +1,1 @@\n+a\n"


def test_rewinding_keeps_what_was_edited_by_hand(spark):
    edits = columns(spark, [("s", 1, "a", None, "1"), ("s", 2, "a", "1", "2"), ("s", 3, "a", "2", "3"), ("s", 4, "b", "x", "y"), ("s", 5, "c", "old", None)], "session string, seq long, path string, old string, new string")
    current = columns(spark, [("s", "a", "3"), ("s", "b", "by hand")], "session string, path string, contents string")
    out = {r["path"]: (r["outcome"], r["contents"]) for r in ledger.rewound(edits, columns(spark, [("s", 1)], "session string, seq long"), current).collect()}
    assert out == {"a": ("restored", "1"), "b": ("skipped", "by hand"), "c": ("restored", "old")}
    block = ledger.pinned_block(columns(spark, [("s", "i", True, "a.ts", "1-2", "code")], "session string, id string, pinned boolean, label string, lines string, contents string")).first()["block"]
    assert block.startswith("## Pinned context\n") and "### a.ts:1-2\n```\ncode\n```" in block


def test_windows_stop_after_failures(spark):
    paths = columns(spark, [(f"p{n}",) for n in range(40)], "path string")
    calls = []

    def fail(frame):
        calls.append(frame.count())
        raise OSError("no answer")

    told = {r["status"] for r in retrieval.embed_in_windows(paths, fail, window=4).collect()}
    assert told == {"failed", "skipped"} and len(calls) == 3
    assert {r["status"] for r in retrieval.embed_in_windows(paths, lambda f: f.count(), window=10).collect()} == {"stored"}
    waits = []
    with pytest.raises(OSError):
        retrieval.retried(lambda: (_ for _ in ()).throw(OSError("x")), 3, 100, retry_after=lambda e: 150.0, sleep=waits.append)
    assert waits == [0.15, 0.2]


def test_live_index_follows_changes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=2)
    now = {"a.py": "first", "b.py": "second"}

    def frame(items):
        return columns(spark, [*items], "path string, contents string").withColumn("hash", F.sha2(F.concat("path", "contents"), 256))

    read = lambda wanted: frame([(r["path"], now[r["path"]]) for r in wanted.collect() if r["path"] in now])
    (tmp_path / "in").mkdir()
    scanned = frame(now.items())
    now.update({"a.py": "first changed", "c.py": "third"})
    rows = [(1, "a.py", "unlink"), (2, "a.py", "change"), (3, "b.py", "unlink"), (4, "c.py", "change"), (5, "lost.py", "change")]
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"seq": s, "path": p, "op": o, "ts": "2024-01-01T00:00:00Z"}) for s, p, o in rows))
    query = changes.live_index(store, scanned, changes.change_stream(spark, str(tmp_path / "in")), read, lambda f: f.select("path", "contents"), str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    fresh = Store(spark, str(tmp_path / "s"), buckets=2)
    assert {r["path"]: r["contents"] for r in fresh.chunks().select("path", "contents").collect()} == {"a.py": "first changed", "c.py": "third"} and {r["path"] for r in fresh.files().collect()} == {"a.py", "c.py"}


def test_index_export(spark, tmp_path):
    frame = spark.range(5)
    files.export_index({"t": frame}, str(tmp_path / "x"), {"model": "m", "dim": 4})
    assert files.import_index(spark, str(tmp_path / "x"), model="m", dim=4)["t"].count() == 5
    with pytest.raises(ValueError, match="dim"):
        files.import_index(spark, str(tmp_path / "x"), dim=5)


def test_change_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [(1, "a", "change"), (2, "a", "unlink"), (3, "b", "change")]
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"seq": s, "path": p, "op": o, "ts": "2024-01-01T00:00:00Z"}) for s, p, o in rows))
    seen = []
    query = changes.keep_index(changes.change_stream(spark, str(tmp_path / "in")), lambda f, n: seen.extend(tuple(r) for r in f.collect()), str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(seen) == [("a", "unlink", 2), ("b", "change", 3)]


def test_folded_stream_drops_replays(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("s", 1, "text", "a"), ("s", 2, "text", "b"), ("s", 2, "text", "b"), ("s", 3, "tool", None)]
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(dict(zip(("session", "seq", "type", "text"), r, strict=True))) for r in rows))
    events = spark.readStream.schema("session string, seq long, type string, text string").json(str(tmp_path / "in"))
    query = changes.folded(events).writeStream.outputMode("update").format("memory").queryName("folded").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [tuple(r) for r in spark.table("folded").collect()] == [("s", 3, 3, "ab")]
