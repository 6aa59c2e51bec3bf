"""Operators 11 to 13 against brute force and the tokenizer library, with odd rows."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter
from itertools import combinations, permutations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spindrift.llm import bpe_codec, filter_audit, registry, spelling

PATH = public_tokenizers.path("word_bpe_49k.json")
DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string"
CLASH = {c: 7 for c in ("part", "same", "first", "subset", "good", "word", "n", "key", "form", "root", "docs", "step")}


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


# filter audit


def failing(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}


def audited(docs, labels):
    """The audit's rows by running every order over every document."""
    least: dict = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    rows = []
    for doc_id, text, lang in docs:
        fails = failing(text or "") | {"E": doc_id is not None and doc_id > least[text or ""]}
        marks = [m for m in labels if m[0] == doc_id and doc_id is not None]
        rows.append((lang or "", {k for k, v in fails.items() if v}, any(m[1] == 1 for m in marks), any(m[2] == 1 for m in marks)))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley: Counter = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone, before = [r for r in left if name in r[1]], left
                left = [r for r in left if name not in r[1]]
                shapley[name] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(name in r[1] for r in own) - sum(name in r[1] for r in before), sum(r[1] == {name} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), found in out.items():
            if p == part:
                found.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_running_every_order(spark):
    rng = random.Random(3)
    long = " ".join(f"w{k}" for k in range(120))
    texts = ["", None, "short one", long, long + " #", long.upper(), "same word " * 80, "a\tb\x0bc\x1cd e " * 60, long + " é", "ONE " * 101, "word " * 100_000]
    docs = [(k, rng.choice(texts), rng.choice(["en", "de", None, ""])) for k in range(150)]
    docs += [(None, long, "en"), (None, None, None), (5, docs[5][1], "en"), (5, "another text", "xx"), docs[7]]
    labels = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 150, 3)] + [(3, 1, None), (3, None, None), (None, 1, 1), (9999, 1, 1)]
    out = filter_audit.audit(frame(spark, docs).withColumns({c: F.lit(v) for c, v in CLASH.items()}), frame(spark, labels, "doc_id long, quality int, toxic int").select("*", F.lit(1).alias("part"), F.lit(1).alias("text")))
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in out.collect()}
    assert got == audited(docs, labels) and len(got) == 600 * 4
    assert filter_audit.audit(frame(spark, []), frame(spark, [], "doc_id long, quality int, toxic int")).count() == 0


# spelling variants


def variants(docs):
    counts: Counter = Counter()
    for doc_id, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near: dict = {w: set() for w in words}
    by_gap: dict = {}
    for w in words:
        for k in range(len(w)):
            by_gap.setdefault((w[:k], w[k + 1 :]), []).append(w)
            if (shorter := w[:k] + w[k + 1 :]) in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in by_gap.values():
        for a, b in combinations(group, 2):
            near[a].add(b)
            near[b].add(a)
    best = {w: min(near[w], key=lambda x: (-words[x], x)) if near[w] else None for w in words}
    form = {w: b if b is not None and words[b] >= 2 * words[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def found(docs):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(docs).collect()}


def test_variants_equal_brute_force(spark):
    documents = registry.table(spark, DATA, "documents")
    assert found(documents) == variants([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_variants_of_dense_words_and_odd_rows(spark):
    rng = random.Random(8)
    letters = "abéÀ"
    dense = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 7))) for _ in range(900)]
    docs = [(k, " ".join(rng.choices(dense, k=60)), "en") for k in range(60)] + [(None, " ".join(dense) + " ÄPFEL Äpfel äpfel ×÷×÷×", None), (1, None, "en"), (2, "", "en"), (3, "12345 !?", "en"), (4, "hello " * 50_000 + "hallo " * 9 + "hullo " * 4, "en")]
    docs += [docs[0], docs[0]]
    want = variants(docs)
    assert found(frame(spark, docs).withColumns({c: F.lit(v) for c, v in CLASH.items()})) == want and any(w[2] != w[1] and w[1] for w in want)
    assert found(frame(spark, [])) == set()


def test_powers_of_letters_differ_by_different_values():
    power = np.array([c**5 for c in [*range(97, 123), *range(192, 256)]], np.int64)
    a, b = np.triu_indices(len(power), 1)
    assert len(set((power[b] - power[a]).tolist())) == len(a)


def test_anagram_keys_do_not_meet_as_a_whole(spark):
    """Of 5,040 orders of the same letters a few meet, not all with all."""
    words = frame(spark, [("".join(p), 3) for p in permutations("abcdefg")], "word string, n long")
    keys = spelling.anagram_keys(words)
    most = keys.groupBy("key", "back", "h").count().agg(F.max("count")).first()[0]
    assert most < 400 and spelling.near_pairs(words).count() == 0


# encoding and decoding


def library():
    return Tokenizer.from_file(PATH)


def test_codec_equals_library_on_documents_and_odd_rows(spark):
    tokenizer = library()
    rows = [(r["doc_id"], r["text"], None) for r in registry.table(spark, DATA, "documents").collect()]
    rows += [(None, "no id", None), (1, None, "x"), (2, "", "x"), (3, " \n\t ", None), (4, "a" * 100_000, None), (5, "word " * 300_000, None), (6, "É ñ ß 中文 😀 \x00 <|endoftext|> x <|ENDOFTEXT|><|startoftext|>", None), rows[0]]
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe_codec.encode_documents(frame(spark, rows).withColumns({c: F.lit(v) for c, v in CLASH.items()}), PATH).collect())
    want = []
    for doc_id, text, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want.append((-1 if doc_id is None else doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe_codec.encode_documents(frame(spark, []), PATH).collect() == []


def test_codec_equals_library_on_random_texts():
    rng, tokenizer = random.Random(4), library()
    letters = "aAbBcéÉßΣσςÄİıǅ'’'s't're'll  \t\n 　 \x1c\x1f\x85123½²Ⅷ٣。，!?#$%<|endoftext|>中文हिन्दी한글é̈😀🏽_-"
    for k in range(1000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        if k % 5 == 0:
            text += "<|endoftext|>" + text + "<|startoftext|>"
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert bpe_codec.encode(text, PATH) == ids and bpe_codec.decode(ids, PATH) == tokenizer.decode(ids, skip_special_tokens=False)
    for _ in range(40):
        word = "".join(rng.choice("abcdeinthors") for _ in range(rng.randint(1, 2000)))
        assert bpe_codec.encode(word, PATH) == tokenizer.encode(word, add_special_tokens=False).ids


def test_words_that_pass_the_checks_are_not_merged(monkeypatch):
    """Speculation decides most words; those that fail, and no others, take the exact merge, and there differ from the greedy proposal or fail a test."""
    own = bpe_codec.Codec(PATH)
    words = sorted({w for t in ("the quick brown fox jumps over lazy dogs and every other animal in the large green forest", "zqxv brrrgh unhappinessly internationalisationer strengthsful") for w in t.split()})
    taken = []
    inner = own.merged_all
    monkeypatch.setattr(own, "merged_all", lambda w: taken.append([len(x) for x in w]) or inner(w))
    tokens, word, failing = own.encode_words([w.encode() for w in words])
    exact = [own.merged([own.first[b] for b in w.encode()[:-1]] + [own.first[w.encode()[-1] + 256]]) for w in words]
    assert [tokens[word == k].tolist() for k in range(len(words))] == exact
    assert 0 < failing < len(words) / 2 and len(taken[-1]) == failing


@pytest.mark.parametrize("most", (5, 1000))
def test_pieces_are_cut_at_white_space(most):
    text = "one two  three\nfour " * 50 + "x" * 3000 + " end"
    cut = list(bpe_codec.pieces(text, most))
    assert [w for p in cut for w in p.split()] == text.split() and (most > 5 or len(cut) > 50)


def test_memory_of_stretches_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe_codec, "MEMO_STRETCHES", 100)
    monkeypatch.setattr(bpe_codec, "BUFFER_CHARS", 200)
    monkeypatch.setattr(bpe_codec.pieces, "__defaults__", (200,))
    own = bpe_codec.codec(PATH)
    own.ids.clear(), own.texts.clear()
    text = " ".join(f"word{k}" for k in range(2000)) + " " + "y" * 500
    ids = library().encode(text, add_special_tokens=False).ids
    (digest,) = bpe_codec.digests([text], PATH)
    assert digest.n == len(ids) and len(own.ids) < 300 and len(own.old[0]) < 300 and all(len(s) <= bpe_codec.MEMO_CHARS for s in own.ids)
