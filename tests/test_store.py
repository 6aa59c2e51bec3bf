"""The stored index: writers beside each other, expiry, and searches that read few blocks."""

import re
import sqlite3
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from spindrift.functions.stem import stem
from spindrift.operators import graph, lexical
from spindrift.operators import store as stores
from spindrift.operators.retrieval import Options, hashing_embedder, overlap_reranker, retrieve
from spindrift.operators.store import ConcurrentChange, Store
from spindrift.sources import fs

SCHEMA = "path string, contents string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def there(store):
    return {r["path"]: r["contents"] for r in store.chunks().select("path", "contents").collect()}


def test_two_writers_keep_each_others_files(spark, tmp_path):
    root = str(tmp_path / "s")
    Store(spark, root).add(frame(spark, [("a", "old one"), ("b", "two")]))
    first, second, third = Store(spark, root), Store(spark, root), Store(spark, root)
    first.add(frame(spark, [("c", "three"), ("a", "new one")]))
    second.add(frame(spark, [("d", "four")]))  # other files: goes behind the first
    with pytest.raises(ConcurrentChange, match="a"):
        third.add(frame(spark, [("a", "lost one"), ("e", "five")]))
    now = Store(spark, root)
    assert there(now) == {"a": "new one", "b": "two", "c": "three", "d": "four"} and now.manifest["version"] == 3
    assert len({r["rowid"] for r in now.chunks().collect()}) == 4 and now.totals()["n"] == 4
    found = now.search(frame(spark, [(1, "one four five lost old")], "query_id int, text string"), 10)
    assert {r["path"] for r in found.join(now.chunks(), "rowid").collect()} == {"a", "d"}
    assert len(fs.names(spark, f"{root}/chunks")) == 3  # nothing of the refused change is left


def test_many_writers_at_once(spark, tmp_path):
    root = str(tmp_path / "s")
    Store(spark, root).add(frame(spark, [("z", "zero")]))
    opened = [Store(spark, root) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: opened[k].add(frame(spark, [(f"p{k}", f"word{k}")])), range(4)))
    assert there(Store(spark, root)) == {"z": "zero"} | {f"p{k}": f"word{k}" for k in range(4)}


def test_a_writer_that_dies_before_its_manifest_leaves_no_trace(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    store = Store(spark, root)
    store.add(frame(spark, [("a", "one")]))

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(stores.fs, "claim", killed)
        with pytest.raises(KeyboardInterrupt):
            Store(spark, root).add(frame(spark, [("a", "two"), ("b", "three")]))
    now = Store(spark, root)
    assert there(now) == {"a": "one"} and len(fs.names(spark, f"{root}/chunks")) == 2
    assert now.expire(grace_s=3600) == [] and len(now.expire(grace_s=0)) > 0
    assert len(fs.names(spark, f"{root}/chunks")) == 1 and there(now) == {"a": "one"}
    now.add(frame(spark, [("b", "four")]))
    assert there(Store(spark, root)) == {"a": "one", "b": "four"}


def test_compaction_beside_a_writer_and_expiry(spark, tmp_path):
    root = str(tmp_path / "s")
    store = Store(spark, root)
    for k in range(3):
        store.add(frame(spark, [(f"p{k}", f"text {k}"), ("again", f"state {k}")]))
    compacting, writing = Store(spark, root), Store(spark, root)
    writing.add(frame(spark, [("late", "text late"), ("p0", "changed")]))
    compacting.compact()
    now = Store(spark, root)
    want = {"p0": "changed", "p1": "text 1", "p2": "text 2", "again": "state 2", "late": "text late"}
    assert there(now) == want and len(now.manifest["segments"]) == 2 and now.totals()["n"] == 5
    hits = lambda s: {r["rowid"]: round(r["score"], 9) for r in s.search(frame(spark, [(1, "text state changed")], "query_id int, text string"), 10).collect()}
    whole, kept = hits(now), now.manifest["version"]
    now.compact()
    assert hits(now) == whole and there(now) == want and len(now.manifest["segments"]) == 1
    now.expire(keep=2, grace_s=0)
    reader = Store(spark, root, version=kept)
    assert there(reader) == want and hits(reader) == whole
    with pytest.raises(PermissionError):
        reader.set_meta(a="b")
    now.expire(keep=1, grace_s=0)
    assert {fs_name for name in stores.TABLES for fs_name in fs.names(spark, f"{root}/{name}")} == {f"segment={now.manifest['segments'][0]['id']}"}
    assert len(fs.names(spark, f"{root}/manifests")) == 1 and not fs.names(spark, f"{root}/_adding") and there(Store(spark, root)) == want
    with pytest.raises(ValueError, match="not kept"):
        Store(spark, root, version=kept)


def corpus(n):
    """Rows in which words are the rarer the longer ago their number's last 0 bit: word1 in every other row, word2 in every fourth."""
    return [(k, f"src/f{k % 7}/{k}.py", " ".join(f"w{j}" for j in range(12) if k % (1 << j) == 0) + " common" * (1 + k % 5) + " filler" * (k % 11)) for k in range(n)]


def test_pruned_search_equals_fts5_and_reads_few_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "PRUNED_FROM", 0)
    monkeypatch.setattr(stores, "SLICE", 64)
    rows = corpus(4000)
    store = Store(spark, str(tmp_path / "s"), buckets=16)
    store.add(frame(spark, rows[:3000], "rowid long, path string, contents string"))
    later = [(k + 10_000, p, c + " later") for k, p, c in rows[2500:3000]] + rows[3000:]
    store.add(frame(spark, later, "rowid long, path string, contents string"))
    live = rows[:2500] + later
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(path, symbol, contents, tokenize='unicode61 remove_diacritics 0')")
    db.executemany("INSERT INTO f(rowid, path, symbol, contents) VALUES (?, ?, '', ?)", live)
    asked = {1: "w11 common", 2: "w9 w3 common filler", 3: "common", 4: "later w1 w2", 5: "nowhere w10", 6: "src w5"}
    taken = []
    inner = Store._best
    monkeypatch.setattr(Store, "_best", lambda self, *a: taken.append(1) or inner(self, *a))
    got = store.search(frame(spark, [*asked.items()], "query_id int, text string"), 10).collect()
    assert taken
    for number, text in asked.items():
        terms = list(dict.fromkeys(re.findall("[a-z0-9_]{2,}", text)))
        want = sorted(((round(s, 9), -k) for k, s in db.execute("SELECT rowid, -bm25(f, 5.0, 6.0, 1.0) FROM f WHERE f MATCH ?", [" OR ".join(f'"{t}"' for t in terms)])), reverse=True)[:10]
        have = [(round(r["score"], 9), -r["rowid"]) for r in sorted((r for r in got if r["query_id"] == number), key=lambda r: r["rank"])]
        assert [s for s, _ in have] == pytest.approx([s for s, _ in want], abs=2e-9) and len(have) == len(want), (text, have, want)


def test_rows_read_for_a_rare_word_do_not_grow(spark, tmp_path, monkeypatch):
    """The postings' scan of a rare word hands on as many rows from a tenfold corpus."""
    read = {}
    for n in (1000, 10_000):
        rows = [(k, f"f{k}", f"common filler{k % 50} own{k}" + (" rareword" if k in (3, 700) else "")) for k in range(n)]
        store = Store(spark, str(tmp_path / f"s{n}"), buckets=n // 100)
        store.add(frame(spark, rows, "rowid long, path string, contents string"))
        asked = frame(spark, [(1, "rareword")], "query_id int, text string")
        assert {r["rowid"] for r in store.search(asked, 10).collect()} == {3, 700}
        blocks = store.postings(["rareword"])
        assert len(blocks.collect()) > 0
        read[n] = blocks._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()
        assert store.search(asked, 10)._jdf.queryExecution().toString().count("/lengths/") == 0
    assert 0 < read[10_000] < 1000 and read[10_000] < 4 * read[1000]


def test_buckets_grow_with_tokens():
    assert [stores.buckets_of(n) for n in (0, 1, 1 << 20, (1 << 20) + 1, 1 << 60)] == [1, 1, 1, 2, stores.MOST_BUCKETS]


def test_a_hot_words_blocks_are_dealt_to_several_buckets(spark):
    found = spark.range(4096).select(stores.bucket_of(F.lit("the"), F.col("id"), 64).alias("b")).distinct().count()
    assert found == stores.SALTS


def test_prefix_narrows_both_legs(spark, tmp_path):
    rows = [(f"{folder}/f{k}.py", f"open the door {k}") for k in range(4) for folder in ("src", "docs", "SRC_x")]
    store = Store(spark, str(tmp_path / "s"), model="m", dim=8)
    store.add(frame(spark, rows), embed=hashing_embedder(8))
    options = Options(embed=hashing_embedder(8), rerank=overlap_reranker, top_k=20)
    own = frame(spark, [(1, "open door", "src/"), (2, "open door", None), (3, "open door", "s%/f1"), (4, "open door", "none/")], "query_id int, text string, path_prefix string")
    found = {}
    for r in retrieve(store, own, options)["results"].collect():
        found.setdefault(r["query_id"], set()).add(r["path"])
    assert found[1] == {f"src/f{k}.py" for k in range(4)} and len(found[2]) == 12 and found[3] == {"src/f1.py", "SRC_x/f1.py"} and 4 not in found
    options.path_prefix = "docs/"
    assert {r["path"] for r in retrieve(store, frame(spark, [(1, "open door")], "query_id int, text string"), options)["results"].collect()} == {f"docs/f{k}.py" for k in range(4)}


def test_fetched_chunks_come_from_their_segments(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.add(frame(spark, [(f"a{k}", f"x {k}") for k in range(50)]))
    store.add(frame(spark, [(f"b{k}", f"y {k}") for k in range(50)]))
    ids = {r["path"]: r["rowid"] for r in store.chunks().collect()}
    wanted = frame(spark, [(ids[p],) for p in ("a7", "b3", "b49")], "rowid long")
    found = store.fetched(wanted)
    assert {r["path"]: r["rowid"] for r in found.collect()} == {p: ids[p] for p in ("a7", "b3", "b49")}
    assert found._jdf.queryExecution().executedPlan().toString().count("PushedFilters: [In(rowid") == 2
    given = Store(spark, str(tmp_path / "t"))
    given.add(frame(spark, [(-5, "n", "z")], "rowid long, path string, contents string"))
    given.add(frame(spark, [("m", "y")]))
    assert {r["path"] for r in given.fetched(given.chunks().select("rowid")).collect()} == {"n", "m"}


def test_expansion_reads_a_stored_adjacency(spark, tmp_path, monkeypatch):
    """A hub of 20,000 edges is cut where it is stored; the plan of an expansion stays small; changes are linked anew."""
    root = str(tmp_path / "s")
    store = Store(spark, root)
    chunk = [("hub.ts", "hub")] + [(f"f{k}.ts", f"s{k}") for k in range(200)]
    rows = frame(spark, [(k, p, s, f"text {s}") for k, (p, s) in enumerate(chunk)], "rowid long, path string, symbol string, contents string").withColumn("parent", F.lit(None).cast("string"))
    edges = spark.range(20_000).select("id", F.concat(F.lit("f"), (F.col("id") % 200).cast("string"), F.lit(".ts")).alias("source_path"), F.concat(F.lit("s"), (F.col("id") % 200).cast("string")).alias("source_symbol"), F.lit("hub.ts").alias("target_path"), F.lit("hub").alias("target_symbol"), F.lit("calls").alias("kind"), F.lit(0.5).alias("confidence"))
    store.add(rows, edges=edges)
    results = rows.where("rowid = 0").withColumn("query_id", F.lit(1)).withColumn("rank", F.lit(1)).withColumn("score", F.lit(1.0))
    found = graph.expand_chunks(results, store.near)
    assert [(r["rowid"], r["score"], r["reason"]) for r in found.orderBy("place").limit(2).collect()] == [(1, 0.275, "f0.ts:s0 calls this"), (2, 0.275, "f1.ts:s1 calls this")] and found.count() == 15
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") < 12
    linked = store.manifest["adjacency"]["id"]
    assert spark.read.parquet(f"{root}/adjacency/segment={linked}").where("node = 0").count() == graph.MOST_EDGES
    monkeypatch.setattr(graph, "chunk_adjacency", lambda *_: pytest.fail("linked again"))
    graph.expand_chunks(results, Store(spark, root).near).count()
    monkeypatch.undo()
    store.remove(frame(spark, [("f0.ts",)], "path string"))
    now = Store(spark, root)
    assert [r["rowid"] for r in graph.expand_chunks(results, now.near).orderBy("place").limit(1).collect()] == [2] and now.manifest["adjacency"]["id"] != linked
    now.expire(grace_s=0)
    assert len(fs.names(spark, f"{root}/adjacency")) == 1


def test_search_with_editor_recency_and_expansion(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), model="m", dim=8)
    rows = [("a.ts", "open", "function open() {}"), ("b.ts", "load", "function load() { open door }"), ("c.ts", "close", "nothing of it")]
    edges = frame(spark, [(1, "a.ts", "open", "c.ts", "close", "calls", 0.9)], "id long, source_path string, source_symbol string, target_path string, target_symbol string, kind string, confidence double")
    store.add(frame(spark, rows, "path string, symbol string, contents string"), edges=edges, embed=hashing_embedder(8))
    asked = frame(spark, [(1, "open", "b.ts", ["b.ts"], "load door")], "query_id int, text string, active_path string, open_paths array<string>, context_text string")
    recency = frame(spark, [("b.ts", 1.0)], "path string, recency double")
    plain = retrieve(store, asked.select("query_id", "text"), Options(top_k=1))["results"].collect()
    assert [r["path"] for r in plain] == ["a.ts"]
    boosted = {r["path"]: r["score"] for r in retrieve(store, asked, Options(top_k=2, recency=recency))["results"].collect()}
    alone = {r["path"]: r["score"] for r in retrieve(store, asked.select("query_id", "text"), Options(top_k=2))["results"].collect()}
    assert boosted["b.ts"] > 1.3 * alone["b.ts"] and boosted["a.ts"] == pytest.approx(alone["a.ts"])
    final = retrieve(store, asked.select("query_id", "text"), Options(top_k=1, expand="graph"))["final"].orderBy("rank").collect()
    assert [(r["path"], r["reason"]) for r in final] == [("a.ts", None), ("c.ts", "calls c.ts:close")]
    other = retrieve(store, asked.select("query_id", "text"), Options(top_k=1, expand="symbols"))["final"].orderBy("rank").collect()
    assert other[0]["path"] == "a.ts" and all(r["reason"] for r in other[1:])


@pytest.mark.parametrize("stemmed", (False, True))
def test_references_by_stored_places(spark, tmp_path, stemmed):
    """Equal to a search of all texts by expression; only chunks that hold the words in a row are read."""
    texts = ["call open_file(x)", "open_files()", "Open_File", "open file", "x.open_file", "openFile", "_open_file", "run; run_all", "RUN", "running run", "open_file open_file", "nothing"]
    rows = [(k, f"f{k}", t) for k, t in enumerate(texts)]
    chunks = frame(spark, rows, "rowid long, path string, contents string")
    store = Store(spark, str(tmp_path / "s"), stemmed=stemmed)
    store.add(chunks.where("rowid < 6"))
    store.add(chunks.where("rowid >= 5"))
    terms = ["open_file", "run", "absent", "openFile", "running"]
    got = {(r["term"], r["rowid"]) for r in store.references(frame(spark, [(t,) for t in terms], "term string")).collect()}
    assert got == {(t, r["rowid"]) for t in terms for r in lexical.references(chunks, t, 100).collect()}
    assert {r["n"] for r in store.references(frame(spark, [("open_file",)], "term string"), 2).collect()} == {1, 2}


def test_rows_in_any_order_make_one_block_a_term_and_slice(spark, tmp_path):
    """Rows that come in many parts, each of which holds some of every slice."""
    rows = [(k, f"f{k}", f"common own{k} words common") for k in range(4096)]
    store = Store(spark, str(tmp_path / "s"))
    store.add(frame(spark, rows, "rowid long, path string, contents string").repartition(24, "path"))
    blocks = store.postings(["common"])
    assert sorted((r["slice"], r["n"]) for r in blocks.collect()) == [(k, 1024) for k in range(4)]
    places = store.unpacked(blocks, "term").select("rowid", "f2", "p2").collect()
    assert len(places) == 4096 and all((r["f2"], r["p2"]) == (2, [0, 3]) for r in places)


def test_numbering_shuffles_texts_once(spark, tmp_path):
    """Numbered rows come by rowid from the table that was written in order: no window and no further exchange of texts."""
    store = Store(spark, str(tmp_path / "s"))
    rows = [(f"p{k * 7919 % 500:03d}", k % 3, f"{k}", f"text {k}") for k in range(500)]
    placed = store.numbered(frame(spark, rows, "path string, start_line int, id string, contents string").repartition(9))
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan
    found = placed.orderBy("rowid").collect()
    assert [r["rowid"] for r in found] == list(range(500)) and [r["path"] for r in found] == sorted(r[0] for r in rows)


@pytest.mark.parametrize("stemmed", (False, True))
def test_packed_blocks_hold_every_place(spark, tmp_path, monkeypatch, stemmed):
    """Blocks are shuffled as one list of numbers, and stored as a plain count of all fields has them."""
    monkeypatch.setattr(stores, "SLICE", 4)
    rows = [(k, f"src/open{k % 3}/run", "runOpen" if k % 2 else None, None, " ".join(["run", "running", f"w{k % 5}", "open"] * (k % 4))) for k in range(23)]
    made = frame(spark, rows[::-1], "rowid long, path string, symbol string, parent string, contents string")
    assert stores.blocks_of(made, stemmed).columns == ["term", "slice", "n", "packed"]
    store = Store(spark, str(tmp_path / "s"), stemmed=stemmed)
    store.add(made)
    want = {}
    for rowid, *texts in [(r, p, "runOpen run Open" if s else "", c) for r, p, s, _, c in rows]:
        lists = [[stem(w) if stemmed else w for w in re.findall("[a-z0-9]+", t.lower())] for t in texts]
        for field, words in enumerate(lists):
            for place, word in enumerate(words):
                want.setdefault((word, rowid), ([], [], []))[field].append(place)
    lengths = {r["rowid"]: (r["n0"], r["n1"], r["n2"]) for r in store.table("lengths").collect()}
    blocks = store.postings()
    got = {(r["term"], r["rowid"]): r for r in store.unpacked(blocks, "term").collect()}
    assert {k: (r["p0"], r["p1"], r["p2"]) for k, r in got.items()} == want
    assert all((r["f0"], r["f1"], r["f2"]) == tuple(map(len, want[k])) and (r["n0"], r["n1"], r["n2"]) == lengths[k[1]] for k, r in got.items())
    for b in blocks.collect():
        own = {k[1]: p for k, p in want.items() if k[0] == b["term"] and k[1] // 4 == b["slice"]}
        assert sorted(b["rowids"]) == sorted(own) and b["n"] == len(own)
        assert [b[f"m{k}"] for k in range(3)] == [max(len(p[k]) for p in own.values()) for k in range(3)]
        assert [b[f"l{k}"] for k in range(3)] == [min(lengths[r][k] for r in own) for k in range(3)]
        masks = [sum(bool(p[k]) << k for k in range(3)) for p in own.values()]
        assert b["counts"] == [masks.count(m) for m in range(1, 8)]


def test_expired_index_rewrites_its_two_segments_once(spark, monkeypatch):
    """The query's index is compacted once and in place, and the segments that this replaced are gone."""
    from spindrift.plans import corpus, lookups

    compacted, roots = [], []
    inner, once = Store.compact, corpus._once
    monkeypatch.setattr(Store, "compact", lambda self, *a: compacted.append(len(self.manifest["segments"])) or inner(self, *a))
    monkeypatch.setattr(corpus, "_once", lambda *a: roots.append(once(*a)) or roots[-1])
    assert lookups.expired_index(spark, "/root/testdata/sf0.001").count() > 0
    assert compacted == [2]
    now = Store(spark, roots[-1])
    assert fs.names(spark, f"{now.root}/chunks") == [f"segment={now.manifest['segments'][0]['id']}"] and len(fs.names(spark, f"{now.root}/manifests")) == 1
