"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words; words at its ignored positions do
not count, so that a passage with some words replaced still shares seed hashes with its
source.  Hits are verified along their diagonal, where replaced words
are tolerated.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import storage, textscan

#: Masks of weight five; of any span of nine words with up to two replaced, most keep a hit.
MASKS = ("11111", "1101011", "1110101", "10110011", "11000111")
#: A passage is a segment of at least so many words (or a whole shorter item) of which at least so large a part agrees.
PASSAGE_WORDS, AGREEMENT = 13, 0.7
#: Items of fewer words say too little to tell a leak from chance in a longer text; they match texts that they are as a whole.
LEAST_WORDS = 5
#: Words of benchmark text that are broadcast at most; a larger benchmark is joined by seed hashes.
SLICE_WORDS = 1_000_000
#: Bits of the filter that lets a document's seeds into that join, a fixed 8 MB.
FILTER_BITS = 1 << 26
#: Hits expanded, and words compared, at a time; these bound the temporary arrays.
HITS, COMPARED = 1 << 20, 1 << 22
MISMATCH = 2

LEAKS = "doc_id long, item_id long, doc_word long, item_word long, words long, agreeing long, item_words long"


def spaced(text):
    """Lower-case words (runs of letters, marks and digits) with single spaces between."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))


def seed_hashes(words: np.ndarray, offsets: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """The mask's hash at each place where its span fits into the row, and those places."""
    span = len(mask)
    counts = np.maximum(np.diff(offsets) - span + 1, 0)
    where = np.concatenate(([0], np.cumsum(counts)))
    place = np.repeat(offsets[:-1] - where[:-1], counts) + np.arange(where[-1])
    total = np.full(len(place), int(mask, 2), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            total = total * np.uint64(0xD6E8FEB86659FD93) + words[place + k]
    return textscan.mix(total), place


def seeds(words: np.ndarray, offsets: np.ndarray):
    """(number, hashes, places) of each mask, and last of the texts below LEAST_WORDS words as a whole."""
    for n, mask in enumerate(MASKS):
        yield n, *seed_hashes(words, offsets, mask)
    size = np.diff(offsets)
    place = offsets[:-1][(size > 0) & (size < LEAST_WORDS)]
    size = size[(size > 0) & (size < LEAST_WORDS)].astype(np.uint64)
    total = size.copy()
    for k in range(LEAST_WORDS - 1):
        more = size > k
        total[more] = textscan.mix(total[more] * np.uint64(0xD6E8FEB86659FD93) + words[place[more] + k])
    yield len(MASKS), total, place


def verified(words: np.ndarray, offsets: np.ndarray, there: np.ndarray, bounds: np.ndarray, row: np.ndarray, item: np.ndarray, shift: np.ndarray) -> list[np.ndarray]:
    """Of diagonals (row, item, shift) those that bear a passage: row, item, agreeing words, words, place in the row, place in the item, the item's words.

    Along a diagonal the segment with the highest score counts: 1 for a word that agrees, -MISMATCH for one that does not.
    """
    size = (bounds[1:] - bounds[:-1])[item]
    first = np.maximum(0, -shift)
    width = np.minimum(size, (offsets[1:] - offsets[:-1])[row] - shift) - first
    need = np.minimum(PASSAGE_WORDS, size)
    out = []
    for a, b in textscan.in_parts(width, COMPARED):
        part = np.arange(a, b)
        for stage in (0, 1):
            if not len(part):
                break
            w = width[part]
            same = there[textscan.ranges(bounds[item[part]] + first[part], w)] == words[textscan.ranges(offsets[row[part]] + first[part] + shift[part], w)]
            upto = np.concatenate(([0], np.cumsum(same)))
            ends = np.cumsum(w)
            if stage == 0:  # too few words agree on the whole diagonal
                part = part[(upto[ends] - upto[ends - w] >= AGREEMENT * need[part])]
        if not len(part):
            continue
        begins = ends - w + np.arange(len(part))  # a 0 stands before each diagonal's words
        score = np.zeros(len(same) + len(part), np.int64)
        inner = textscan.ranges(begins + 1, w)
        score[inner] = np.where(same, 1, -MISMATCH)
        # each diagonal lies far below those before, so that their lows do not count for it
        total = np.cumsum(score) - np.repeat(np.arange(len(part)) << 32, w + 1)
        low = np.minimum.accumulate(total)
        gain = total - low
        best = np.maximum.reduceat(gain, begins)
        hit = np.flatnonzero(gain == np.repeat(best, w + 1))
        end = hit[np.searchsorted(hit, begins)]
        start = np.maximum.accumulate(np.where(total == low, np.arange(len(total)), 0))[end]
        agree = np.zeros(len(score), np.int64)
        agree[inner] = same
        agree = np.cumsum(agree)
        agreeing, length, at = agree[end] - agree[start], end - start, start - begins + first[part]
        good = (length >= need[part]) & (agreeing >= AGREEMENT * length)
        out.append(np.stack([row[part], item[part], agreeing, length, at + shift[part], at, size[part]])[:, good])
    return [*np.concatenate(out, 1)] if out else [np.zeros(0, np.int64)] * 7


class Index:
    """Seed hashes of the benchmark, or of a part of it."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = np.array([i for i, _ in items], np.int64)
        self.words = np.concatenate([w for _, w in items]) if items else np.zeros(0, np.uint64)
        self.offsets = np.concatenate(([0], np.cumsum([len(w) for _, w in items]))).astype(np.int64)
        self.tables = []
        for _, hashes, place in seeds(self.words, self.offsets):
            order = np.argsort(hashes, kind="stable")
            self.tables.append((hashes[order], place[order]))

    def diagonals(self, words: np.ndarray, offsets: np.ndarray):
        """(row, item, shift) of the hits, HITS or little more at a time, each diagonal once in them."""
        for n, hashes, place in seeds(words, offsets):
            known, places = self.tables[n]
            left = np.searchsorted(known, hashes)
            hit = np.flatnonzero(known[np.minimum(left, len(known) - 1)] == hashes) if len(known) else np.zeros(0, np.int64)
            left, place = left[hit], place[hit]
            count = np.searchsorted(known, hashes[hit], "right") - left
            for a, b in textscan.in_parts(count, HITS):
                here, there = np.repeat(place[a:b], count[a:b]), places[textscan.ranges(left[a:b], count[a:b])]
                row, item = np.searchsorted(offsets, here, "right") - 1, np.searchsorted(self.offsets, there, "right") - 1
                shift = (here - offsets[row]) - (there - self.offsets[item])
                order = np.lexsort((shift, item, row))
                row, item, shift = row[order], item[order], shift[order]
                fresh = np.ones(len(row), bool)
                fresh[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1])
                yield row[fresh], item[fresh], shift[fresh]

    def leaks(self, words: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """(row, item, place in the row, place in the item, words, agreeing words, the item's words), best for each row and item."""
        found = [verified(words, offsets, self.words, self.offsets, *d) for d in self.diagonals(words, offsets)]
        return best_leaks(found, self.items)


def best_leaks(found: list[list[np.ndarray]], items: np.ndarray) -> list[tuple]:
    """Of the passages of each row and item the one with most agreeing words, then words, then the first."""
    if not found:
        return []
    row, item, agreeing, length, here, there, size = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((there, -here, length, agreeing, item, row))
    row, item = row[order], item[order]
    last = np.ones(len(row), bool)
    last[:-1] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
    take = order[last]
    return [*zip(row[last].tolist(), items[item[last]].tolist(), here[take].tolist(), there[take].tolist(), length[take].tolist(), agreeing[take].tolist(), size[take].tolist(), strict=True)]


NAMES = [x.split()[0] for x in LEAKS.split(", ")]


def find_leaks(documents: DataFrame, benchmark: DataFrame, slice_words: int = SLICE_WORDS) -> DataFrame:
    """One row for each document row and benchmark item of which it holds a passage: LEAKS.

    A benchmark of at most slice_words words is broadcast, and each document is read once; a larger one is joined
    by its seeds.  Null and empty texts hold and leak nothing; items without an item_id match nothing, and those of fewer than
    LEAST_WORDS words only texts that have the same words and no others.  Repeated documents are reported each, repeated
    items (by item_id and text) once, at the best place; of equally good places the first
    counts.  Empty tables give no rows.  Other columns than doc_id, text, item_id are not read.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), spaced(F.col("text")).alias("text"))
    items, size = _items(benchmark)
    if not size:
        return documents.sparkSession.createDataFrame([], LEAKS)
    if size > slice_words:
        keyed = rows.withColumn("key", _key())
        leaks = _joined(keyed.dropDuplicates(["key"]), items, -(-size // slice_words))
        return keyed.select("key", "doc_id").join(leaks, "key").select(NAMES)
    index = _index(items)

    def run(batches):
        for batch in batches:
            for begin, end in textscan.blocks(batch["text"]):
                ids = batch["doc_id"].slice(begin, end - begin)
                found = index.value.leaks(*textscan.word_hashes(batch["text"].slice(begin, end - begin)))
                if found:
                    columns = [*zip(*found, strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0])), *(pa.array(c, pa.int64()) for c in columns[1:])], names=NAMES)

    return rows.mapInArrow(run, LEAKS)


def clean_documents(documents: DataFrame, benchmark: DataFrame, slice_words: int = SLICE_WORDS) -> DataFrame:
    """The documents that hold no benchmark passage, with all their columns; one pass and no shuffle for a benchmark of at most slice_words words."""
    items, size = _items(benchmark)
    if not size:
        return documents
    spelled = documents.withColumn("_spaced", spaced(F.col("text")))
    if size > slice_words:
        rows = spelled.select(F.col("_spaced").alias("text")).withColumn("key", _key(("text",))).dropDuplicates(["key"])
        leaking = _joined(rows, items, -(-size // slice_words)).select(F.col("key").alias("_key")).distinct()
        keyed = documents.withColumn("_key", _key((spaced(F.col("text")),)))
        return keyed.join(leaking, "_key", "left_anti").drop("_key")
    index = _index(items)

    def run(batches):
        for batch in batches:
            text = batch["_spaced"]
            rest = batch.drop_columns(["_spaced"])
            for begin, end in textscan.blocks(text):
                leaking = {x[0] for x in index.value.leaks(*textscan.word_hashes(text.slice(begin, end - begin)))}
                yield rest.slice(begin, end - begin).filter(pa.array([n not in leaking for n in range(end - begin)]))

    return spelled.mapInArrow(run, documents.schema)


def _items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The distinct items (item_id, text), and the number of their words."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), spaced(F.col("text")).alias("text")).where("item_id is not null and text != ''").distinct()
    return items, items.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0


def _index(items: DataFrame):
    """The broadcast index over items, whose number of words is known to be bounded."""
    found = items.orderBy("item_id", "text").toArrow()
    words, offsets = textscan.word_hashes(found["text"].combine_chunks())
    held = [(i, words[a:b]) for i, a, b in zip(found["item_id"].to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return items.sparkSession.sparkContext.broadcast(Index(held))


def _key(columns=("doc_id", "text")):
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.unhex(F.md5(F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("\0")) for p in parts])))


def _seeded(texts: DataFrame, key: str, key_type: str, allowed=None) -> DataFrame:
    """key, mask, hash, place of every seed of texts (key, text); of those only that the filter lets through."""
    names = [key, "mask", "hash", "place"]

    def run(batches):
        for batch in batches:
            for begin, end in textscan.blocks(batch["text"]):
                part = batch.slice(begin, end - begin)
                words, offsets = textscan.word_hashes(part["text"])
                for n, hashes, place in seeds(words, offsets):
                    if allowed is not None:
                        bit = (hashes ^ np.uint64(n)) % np.uint64(FILTER_BITS)
                        passed = (allowed.value[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                        hashes, place = hashes[passed], place[passed]
                    row = np.searchsorted(offsets, place, "right") - 1
                    yield pa.RecordBatch.from_arrays([part[key].take(pa.array(row)), pa.array(np.full(len(row), n, np.int32)), pa.array(hashes.view(np.int64)), pa.array(place - offsets[row])], names=names)

    return texts.select(key, "text").mapInArrow(run, f"{key} {key_type}, mask int, hash long, place long")


def _joined(rows: DataFrame, items: DataFrame, slices: int) -> DataFrame:
    """key and LEAKS but for doc_id, of rows (key, text) against a benchmark that is too large to broadcast.

    Seeds meet by their hashes.  The diagonals of a row are verified beside its own words in as many tasks as there are slices of
    the benchmark, so no task holds more of it than about a slice.  Only a filter of FILTER_BITS bits is broadcast.
    """
    spark = rows.sparkSession
    items = storage.keep(items.withColumn("item", _key(("item_id", "text"))), "leak-items")
    known = storage.keep(_seeded(items, "item", "binary"), "leak-seeds")
    bit = F.col("hash").bitwiseXOR(F.col("mask").cast("long")).bitwiseAND(F.lit(FILTER_BITS - 1))
    bytes_set = known.select(bit.alias("bit")).groupBy(F.shiftright("bit", 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit & 7 as int))")).alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS >> 3, np.uint8)
    table[bytes_set["byte"].to_numpy()] = bytes_set["bits"].to_numpy().astype(np.uint8)
    allowed = spark.sparkContext.broadcast(table)
    rows = storage.keep(rows.select("key", "text"), "leak-rows")
    met = _seeded(rows, "key", "binary", allowed).withColumnRenamed("place", "here").join(known, ["mask", "hash"])
    part = F.pmod(F.xxhash64("item"), F.lit(slices)).cast("int")
    diagonals = storage.keep(met.select("key", "item", (F.col("here") - F.col("place")).alias("shift")).distinct().withColumn("part", part), "leak-diagonals")
    left = diagonals.join(items.select("item", "item_id", F.col("text").alias("item_text")), "item").select("key", "part", "item_id", "item_text", "shift")
    right = diagonals.select("key", F.col("part").alias("row_part")).distinct().join(rows, "key").select(F.col("key").alias("row_key"), "row_part", "text")

    def verify(key: tuple, met: pd.DataFrame, row: pd.DataFrame) -> pd.DataFrame:
        words, offsets = textscan.word_hashes(pa.array(row["text"].iloc[:1], pa.string()))
        which, texts = pd.factorize(met["item_text"] + "\0" + met["item_id"].astype(str))
        first = met.groupby(which)[["item_id", "item_text"]].first()
        there, bounds = textscan.word_hashes(pa.array(first["item_text"], pa.string()))
        order = np.lexsort((met["shift"].to_numpy(), which))
        found = verified(words, offsets, there, bounds, np.zeros(len(met), np.int64), which[order].astype(np.int64), met["shift"].to_numpy()[order])
        leaks = best_leaks([found], first["item_id"].to_numpy())
        out = pd.DataFrame([x[1:] for x in leaks], columns=NAMES[1:], dtype="int64")
        return out.assign(key=[key[0]] * len(out))[["key", *NAMES[1:]]]

    schema = "key binary, " + LEAKS.split(", ", 1)[1]
    return left.groupBy("key", "part").cogroup(right.groupBy("row_key", "row_part")).applyInPandas(verify, schema)
