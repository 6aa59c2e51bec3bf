"""Packing: documents into token sequences by order-preserving dynamic programming.

One pass tokenizes every text and keeps, for each document, where it may be cut
(document end, sentence ends, and every HARD_EVERY tokens of a longer sentence)
with the CRC of all ids up to there.  Only these short records are shuffled: ranges of
doc_ids with equal numbers of rows go to one task each, which chooses the cuts of the
concatenated stream.  A CRC of any piece follows from two prefix CRCs, so no
id is moved.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import bpe_transducer, textscan

WINDOW = 2048
#: What cutting a document costs, in tokens of padding: at the end of a sentence, and within one.
SENTENCE_CUT, HARD_CUT = 2, 64
#: What each further sequence costs, in tokens of padding: half a window, so that a piece whose length is a power of
#: two, and which needs no padding, is not cheaper than a place in a full sequence.
SEQUENCE = WINDOW // 2
HARD_EVERY = 256
#: Rows of a block aimed at, and ranges of doc_id at most.
BLOCK_DOCS, MOST_RANGES = 1024, 4096
#: A block's rows are packed in runs of at most so many tokens, which bounds memory; a sequence ends with its run.
RUN_TOKENS = 8_000_000
END_ID = 1
#: Before white space behind . ! or ?, and before a line feed.
SENTENCE_END = re.compile(r"(?<=[.!?])(?= )|(?=\n)")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=1)
def _zeros_operators() -> np.ndarray:
    """Tables [k, byte place, byte] that carry a CRC-32 over 2^k zero bytes, k = 0..63."""
    table = np.array([zlib.crc32(bytes((b,))) ^ zlib.crc32(b"\0") for b in range(256)], np.uint64)

    def spread(columns: list[int]) -> np.ndarray:
        out = np.zeros((4, 256), np.uint64)
        for place in range(4):
            for byte in range(256):
                out[place, byte] = np.bitwise_xor.reduce([np.uint64(columns[8 * place + k]) for k in range(8) if byte >> k & 1] or [np.uint64(0)])
        return out

    columns = [int(table[(1 << k) & 255]) ^ ((1 << k) >> 8) for k in range(32)]
    made = []
    for _ in range(64):
        made.append(spread(columns))
        columns = [int(x) for x in _through(made[-1], np.array(columns, np.uint64))]
    return np.stack(made)


def _through(operator: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = np.zeros(len(crc), np.uint64)
    for place in range(4):
        out ^= operator[place, ((crc >> np.uint64(8 * place)) & np.uint64(255)).astype(np.int64)]
    return out


def crc_between(before: np.ndarray, after: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """The CRC-32 of the last n_bytes bytes, from those of everything before them and of the whole."""
    moved, n, k = before.astype(np.uint64), n_bytes.astype(np.uint64), 0
    operators = _zeros_operators()
    while (n >> np.uint64(k)).any():
        on = (n >> np.uint64(k)) & np.uint64(1) == 1
        moved[on] = _through(operators[k], moved[on])
        k += 1
    return moved ^ after.astype(np.uint64)


def choose_cuts(at: np.ndarray, penalty: np.ndarray, window: int = WINDOW, sequence: int = SEQUENCE) -> np.ndarray:
    """Indices into at (ascending, from 0) of the best window ends.

    best[j] = penalty[j] + min over i with at[j] - at[i] <= window of best[i] + padding.
    The padding of a window of power-of-two length is 0, else window less its
    length; for the latter, best[i] + at[i] is all that depends on i, so a
    monotone queue holds the minimum.
    """
    n = len(at)
    exact: dict[int, list[int]] = {}
    size = 1
    while size <= window:
        found = np.searchsorted(at, at - size)
        hit = (found < n) & (at[np.minimum(found, n - 1)] == at - size) & (at >= size)
        for j in np.flatnonzero(hit).tolist():
            exact.setdefault(j, []).append(int(found[j]))
        size *= 2
    place, cost = at.tolist(), penalty.tolist()
    best, back, queue = [0] * n, [0] * n, deque([(0, 0, 0)])  # (best + at, index, at)
    for j in range(1, n):
        here = place[j]
        while here - queue[0][2] > window:
            queue.popleft()
        value, source = queue[0][0] + window - here, queue[0][1]
        for i in exact.get(j, ()):
            if best[i] <= value:
                value, source = best[i], i
        best[j], back[j] = value + sequence + cost[j], source
        key = best[j] + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j, here))
    ends, j = [], n - 1
    while j:
        ends.append(j)
        j = back[j]
    return np.array(ends[::-1], np.int64)


def with_specials(text: str, tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a text that holds special strings, and the numbers of ids that begin before its sentence ends."""
    coded = tokenizer.encode(text, add_special_tokens=False)
    begins = np.maximum.accumulate(np.array([a for a, _ in coded.offsets], np.int64))
    return np.array(coded.ids, np.uint32), np.searchsorted(begins, [m.start() for m in SENTENCE_END.finditer(text)])


def documents_ids(texts: pa.Array, path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its ids (uint32) and, ascending, the numbers of ids up to its sentence ends."""
    memo = bpe_transducer.codes(path)
    special = bpe_transducer.special_pattern(path)
    nothing = np.zeros(0, np.int64)
    for begin, end in textscan.blocks(texts):
        plain, odd = [], {}
        for row, text in enumerate(texts.slice(begin, end - begin).to_pylist()):
            text = text or ""
            if "<|" in text and special.search(text):
                odd[row] = with_specials(text, memo.tokenizer)
                text = ""
            plain.append(bpe_transducer.normal(text).encode())
        raw = b"\n".join(plain)
        data = np.frombuffer(raw, np.uint8)
        starts, ends = textscan.units(data)
        hashes = textscan.span_hashes(data, starts, ends)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        found = [memo[raw[a:b].decode()] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        flat = np.frombuffer(b"".join(found), np.uint32)
        sizes = np.array([len(c) >> 2 for c in found], np.int64)
        begins = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        lengths = sizes[which] if len(which) else nothing
        upto = np.concatenate(([0], np.cumsum(lengths)))
        ids = flat[np.repeat(begins[which] - upto[:-1], lengths) + np.arange(upto[-1])] if len(which) else flat
        # a sentence ends behind a line, or behind . ! ? before white space
        stop = np.zeros(len(data), bool)
        if len(data) > 1:
            stop[1:] = ((data[:-1] == 46) | (data[:-1] == 33) | (data[:-1] == 63)) & ((data[1:] == 32) | (data[1:] == 10))
            stop |= data == 10
        stops = upto[np.searchsorted(starts, np.flatnonzero(stop))]
        rows = np.concatenate(([0], np.cumsum([len(p) + 1 for p in plain])))
        tokens = upto[np.searchsorted(starts, rows)]
        stop_rows = np.searchsorted(np.flatnonzero(stop), rows)
        for row in range(end - begin):
            if row in odd:
                yield odd[row]
            else:
                a, b = tokens[row], tokens[row + 1]
                yield ids[a:b], stops[stop_rows[row] : stop_rows[row + 1]] - a


def cut_record(ids: np.ndarray, stops: np.ndarray) -> tuple[int, bytes, bytes]:
    """Token number with the end id; where to cut (twice the place, plus 1 within a sentence); CRCs up to there."""
    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
    total = len(ids)
    stops = np.unique(np.concatenate((stops[(stops > 0) & (stops < total - 1)], [total])))
    gaps = np.diff(stops, prepend=0)
    more = [np.arange(e - g + HARD_EVERY, e, HARD_EVERY) for e, g in zip(stops[gaps > HARD_EVERY], gaps[gaps > HARD_EVERY], strict=True)]
    places = np.concatenate((stops * 2, *[m * 2 + 1 for m in more]))
    places.sort()
    raw, crc, at, crcs = memoryview(ids.tobytes()), 0, 0, []
    for place in (places >> 1).tolist():
        crc = zlib.crc32(raw[4 * at : 4 * place], crc)
        crcs.append(crc)
        at = place
    return total, places.astype("<i8").tobytes(), np.array(crcs, "<u4").tobytes()


class Blocks:
    """Which block a row goes to: ranges of doc_id with about equal numbers of rows, in its order.

    Bounds are quantiles of all doc_ids, MOST_RANGES at most.  Rows of one doc_id that are too many for a block,
    and rows without one, are dealt to several blocks in turn.
    """

    def __init__(self, documents: DataFrame):
        ids = documents.select(F.col("doc_id").cast("long").alias("doc_id"))
        n = ids.where("doc_id is not null").count()
        ranges = min(MOST_RANGES, n // BLOCK_DOCS + 1)
        asked = [k / ranges for k in range(1, ranges)]
        found = (ids.agg(F.percentile_approx("doc_id", asked, 10 * MOST_RANGES).alias("q")).first()["q"] or []) if asked else []
        again = {a + 1 for a, b in zip(found, found[1:], strict=False) if a == b and a < (1 << 63) - 1}
        self.bounds = np.array(sorted({*found, *again}), np.int64)
        names = ["place", "n", "low", "high"]

        def count(batches):
            for batch in batches:
                place, own = self.ranges_of(batch["doc_id"])
                for k in np.unique(place).tolist():
                    some = own[place == k]
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (k, len(some), some.min(), some.max())], names=names)

        sums = ids.mapInArrow(count, "place long, n long, low long, high long").groupBy("place").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        # a range without a doc_id, or with one only, may be parted
        parts = np.ones(len(self.bounds) + 2, np.int64)
        for r in sums.collect():
            if r["place"] == 0 or r["low"] == r["high"]:
                parts[r["place"]] = -(-r["n"] // BLOCK_DOCS)
        self.parts, self.first = parts, np.concatenate(([0], np.cumsum(parts)))[:-1]

    def ranges_of(self, doc_id: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each row's range (0: no doc_id) and doc_id (0 for none)."""
        own = pc.fill_null(doc_id, 0).to_numpy(zero_copy_only=False)
        return np.where(pc.is_null(doc_id).to_numpy(zero_copy_only=False), 0, np.searchsorted(self.bounds, own, "right") + 1), own

    def of(self, doc_id: pa.Array, row: int) -> np.ndarray:
        """Blocks of rows, the first of which is the task's row-th."""
        place, _ = self.ranges_of(doc_id)
        return self.first[place] + (row + np.arange(len(place))) % self.parts[place]


def cut_records(documents: DataFrame, path: str, blocks: Blocks) -> DataFrame:
    """block, doc_id, doc_tokens, places, crcs."""
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("places", pa.binary()), ("crcs", pa.binary())])

    def run(batches):
        row = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                found = [cut_record(*x) for x in documents_ids(part["text"], path)]
                yield pa.RecordBatch.from_arrays([pa.array(blocks.of(part["doc_id"], row)), part["doc_id"], *(pa.array([f[k] for f in found], schema.field(k + 2).type) for k in range(3))], schema=schema)
                row += part.num_rows

    return documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "block long, doc_id long, doc_tokens long, places binary, crcs binary")


def packed_run(docs: list[tuple], block: int, sequence: int, window: int) -> tuple[pa.RecordBatch, int]:
    """The pieces of some documents (doc_id, tokens, places, crcs); the next sequence number."""
    places = [np.frombuffer(d[2], "<i8") for d in docs]
    crcs = np.concatenate([np.frombuffer(d[3], "<u4") for d in docs]).astype(np.int64)
    tokens = np.array([d[1] for d in docs], np.int64)
    first = np.concatenate(([0], np.cumsum(tokens)))
    counts = np.array([len(p) for p in places])
    doc = np.repeat(np.arange(len(docs)), counts)
    inner = np.concatenate(places)
    at = np.concatenate(([0], first[doc] + (inner >> 1)))
    penalty = np.concatenate(([0], np.where(inner & 1, HARD_CUT, SENTENCE_CUT)))
    penalty[np.cumsum(counts)] = 0
    ends = choose_cuts(at, penalty, window)
    # pieces end where a window or a document does
    stop = np.union1d(ends, np.cumsum(counts))
    start = np.concatenate(([0], stop[:-1]))
    of = doc[stop - 1]
    begin = at[start] - first[of]
    before = np.where(begin > 0, crcs[np.maximum(start - 1, 0)], 0)
    length = at[stop] - at[start]
    number = np.searchsorted(ends, stop)
    opened = np.concatenate(([0], at[ends]))[number]
    base = (block << 40) + sequence
    return pa.RecordBatch.from_arrays(
        [
            pa.array([docs[k][0] for k in of.tolist()], pa.int64()), pa.array(begin), pa.array(length),
            pa.array(crc_between(before, crcs[stop - 1], 4 * length).astype(np.int64)), pa.array(tokens[of]),
            pa.array(base + number), pa.array(at[start] - opened),
        ],
        names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    ), sequence + len(ends)


def pack(documents: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The order kept is that of doc_id within a block, whose rows lie in one range of doc_ids.  Null and empty texts hold
    the end id alone.  Rows with equal doc_id are packed one after the other, unless they are too many for a block; those without
    one go to blocks of their own.  An empty table gives no rows.  Columns other than
    doc_id and text are not read.
    """

    def run(batches):
        docs, now, held, sequence = [], None, 0, 0
        for batch in batches:
            for key, *record in zip(*(batch[k].to_pylist() for k in ("block", "doc_id", "doc_tokens", "places", "crcs")), strict=True):
                if docs and (key != now or held >= RUN_TOKENS):
                    out, sequence = packed_run(docs, now, sequence, window)
                    yield out
                    docs, held = [], 0
                if key != now:
                    now, sequence = key, 0
                docs.append(tuple(record))
                held += record[1]
        if docs:
            yield packed_run(docs, now, sequence, window)[0]

    return cut_records(documents, path, Blocks(documents)).repartition("block").sortWithinPartitions("block", "doc_id", "crcs").mapInArrow(run, PIECES)
