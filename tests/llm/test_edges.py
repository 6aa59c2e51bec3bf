"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables, for every operator and stage."""

import public_tokenizers
import pytest

from spindrift.llm import decontamination, html_text, jaccard_join, neighbours, packing, quality, secrets, sharding, token_counts, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "label int, size int, rank int, key int, node int, block int, shard int, row_id int, copies int"
LABELS = "doc_id long, quality int, toxic int"
PROSE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
ROWS = [
    (1, PROSE, "en", "a", 5), (1, PROSE, "en", "a", 5), (2, PROSE, None, None, None), (3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, " \n\t ", "en", "a", 4), (6, "x", "en", "a", 1),
    (7, "word " * 60_000, "en", "a", None), (8, "a" * 200_000, "en", "a", None), (None, PROSE + " more", "en", "a", 1), (None, None, None, None, None), (9, "É ñ ß 中文 😀 \x00 <|endoftext|> token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"", "en", "a", 9),
    (-5, PROSE.upper(), "en", "a", 1),
]
OPERATORS = {
    "tokens": lambda d, t: token_counts.count_tokens(d, PATH),
    "pack": lambda d, t: packing.pack(d, PATH),
    "shard": lambda d, t: sharding.shard(d),
    "quality": lambda d, t: quality.score(d, t["labels"]),
    "keep_good": lambda d, t: quality.keep_good(d, t["labels"]),
    "toxicity": lambda d, t: toxicity.score(d, t["labels"]),
    "leaks": lambda d, t: decontamination.find_leaks(d, t["benchmark"]),
    "clean": lambda d, t: decontamination.clean_documents(d, t["benchmark"]),
    "join": lambda d, t: jaccard_join.classes(d),
    "one_of_each": lambda d, t: jaccard_join.one_of_each(d),
    "secrets": lambda d, t: secrets.find_secrets(d),
    "redact": lambda d, t: secrets.redact(d),
}
ONE_ROW_EACH = ("tokens", "shard", "quality", "toxicity", "join", "redact")
SAME_COLUMNS = ("keep_good", "clean", "one_of_each", "redact")


@pytest.fixture(scope="module")
def tables(spark):
    labels = [(k, int(k % 2 == 0), int(k % 3 == 0)) for k in range(10)] + [(1, None, None), (None, 1, 1)]
    return {
        "labels": spark.createDataFrame(labels, LABELS), "benchmark": spark.createDataFrame([(1, PROSE), (1, PROSE), (2, None), (3, ""), (4, "too short"), (None, PROSE)], "item_id long, text string"),
        "docs": spark.createDataFrame([(*r, *range(9)) for r in ROWS], f"{SCHEMA}, {CLASH}"),
    }


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, tables, name):
    out = OPERATORS[name](tables["docs"], tables)
    rows = out.collect()
    if name in ONE_ROW_EACH:
        assert len(rows) == len(ROWS)
    if name in SAME_COLUMNS:
        assert out.columns == tables["docs"].columns
    if name == "tokens":
        assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0}
    if name == "join":
        of = {r["doc_id"]: r for r in rows}
        assert of[2]["class_id"] == of[1]["class_id"] == -5 and of[3]["class_id"] == 3 and of[4]["n_links"] == 0 and of[2]["n_links"] == 4
    if name == "leaks":
        assert {r["doc_id"] for r in rows} == {1, 2, -5, None} and {r["item_id"] for r in rows} == {1}
    if name == "clean":
        assert {r["doc_id"] for r in rows} == {3, 4, 5, 6, 7, 8, 9, None}
    if name == "one_of_each":
        assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [-5, 3, 4, 5, 6, 7, 8, 9]
    if name == "pack":
        ends = {}
        for r in rows:
            ends[r["doc_id"]] = ends.get(r["doc_id"], 0) + r["length"]
        of = {r["doc_id"]: r["doc_tokens"] for r in rows}
        assert len(of) == 11 and all(of[k] == ends[k] for k in (2, 3, 4, 5, 6, 7, 8, 9, -5)) and of[3] == of[4] == of[5] == 1 and ends[1] == 2 * of[1]
    if name == "secrets":
        assert [r["doc_id"] for r in rows] == [9]
    if name == "keep_good":
        assert not {3, 4, 5} & {r["doc_id"] for r in rows}
    if name == "toxicity":
        assert len({r["score"] for r in rows if r["doc_id"] in (3, 4, 5)}) == 1 and len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    if name == "redact":
        assert next(r for r in rows if r["doc_id"] == 9)["text"].endswith('"[SECRET]"')
    if name == "quality":
        assert {r["predicted"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0}
    if name == "shard":
        assert len({r["shard"] for r in rows if r["text_crc32"] == 0}) == 1 and all(r["law"] == "bytes" and r["grown_shard"] is None for r in rows)
        for s in range(8):
            slots = sorted(r["slot"] for r in rows if r["shard"] == s)
            assert slots == list(range(len(slots)))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, tables, name):
    empty = {"docs": tables["docs"].limit(0), "labels": tables["labels"].limit(0), "benchmark": tables["benchmark"].limit(0)}
    assert OPERATORS[name](empty["docs"], empty).collect() == []


def test_without_labels_or_benchmark(spark, tables):
    none = {"labels": tables["labels"].limit(0), "benchmark": tables["benchmark"].limit(0)}
    assert {r["score"] for r in quality.score(tables["docs"], none["labels"]).collect()} == {0.5}
    assert decontamination.clean_documents(tables["docs"], none["benchmark"]).count() == len(ROWS)


def test_pipeline_on_odd_rows(spark, tables, tmp_path):
    """run() on nulls, empty and long texts and repeated rows, and on an empty table."""
    import corpus_pipeline

    folder = str(tmp_path)
    tables["labels"].write.parquet(f"{folder}/labels.parquet")
    tables["benchmark"].write.parquet(f"{folder}/benchmark.parquet")
    tables["docs"].select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in rows} <= {r[0] for r in ROWS}
    tables["docs"].limit(0).select("doc_id", "text", "lang", "source", "n_chars").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_vectors(spark):
    rows = [(k, [float(k % 7 + 1), float(k % 5), 1.0], 0) for k in range(300)] + [(100, [3.0, 0.0, 1.0], 0), (500, None, 0), (600, [], 0), (700, [0.0, 0.0, 0.0], 0), (800, [None, 1.0, 2.0], 0), (900, [float("nan"), 1.0, 1.0], 0), (1000, [float("inf"), 1.0, 1.0], 0), (None, [1.0, 1.0, 1.0], 0), (1100, [1.0, 2.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    out = neighbours.nearest(frame).collect()
    assert {r["query_id"] for r in out} == {0, 100, 200} and len(out) == 30
    first = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == 0)
    assert [v for _, v, _ in first][:3] == [35, 70, 105] and first[0][2] == 0.0
    assert neighbours.nearest(frame.limit(0)).collect() == []


def test_pages(spark):
    rows = [(1, "u", None, 0), (None, None, "", 0), (2, "u", "<p>Hi &amp; bye<br>now</p>", 0), (3, "u", "<div><p>unclosed <b>text", 0), (4, "u", "<" * 5000, 0), (5, "u", "<div>" * 3000 + "deep", 0), (2, "u", "<p>Hi &amp; bye<br>now</p>", 0)]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(out) == len(rows)
    texts = {r["page_id"]: r["text"] for r in out}
    assert texts[1] == "" and texts[2] == "Hi & bye now" and texts[3] == "unclosed text" and texts[5] == "deep"
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
