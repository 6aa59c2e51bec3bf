"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import textscan

#: Labelled documents that the field is fitted on at most (each class half); of a text of more bytes a window.
SAMPLE_DOCS, SAMPLE_BYTES = 2000, 1 << 16
GOOD_SCORE = 0.7


def held_out():
    """Rows whose label is never learned from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


_UPPER, _DIGIT, _SPACE, _STOP, _SHOUT, _BAR, _SYMBOL, _HIGH, _LOWER = range(9)
_KIND = np.full(256, _SYMBOL, np.uint8)
for _kind, _bytes in ((_UPPER, range(65, 91)), (_LOWER, range(97, 123)), (_DIGIT, range(48, 58)), (_SPACE, (9, 11, 12, 13, 32)), (_STOP, b".,;:'\"()-"), (_SHOUT, b"!?"), (_BAR, b"|"), (_HIGH, range(128, 256))):
    _KIND[list(_bytes)] = _kind


def line_features(raw: bytes, row_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the lines that hold more than white space, their bytes, and the rows' offsets into them.

    raw holds the rows with a line feed after each; row_at the rows' offsets.
    """
    data = np.frombuffer(raw, np.uint8)
    kind = _KIND[data]
    stop = np.flatnonzero(data == 10)
    start = np.concatenate(([0], stop[:-1] + 1)) if len(stop) else stop
    spaces = kind == _SPACE
    inked = np.concatenate(([0], np.cumsum(~spaces & (data != 10))))
    full = inked[stop] > inked[start]
    start, stop = start[full], stop[full]
    n = len(start)
    rows = np.searchsorted(start, row_at)
    if not n:
        return np.zeros((0, 2 * 13 + 1)), np.zeros(0), rows

    def part(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[stop] - total[start]

    size = stop - start
    counts = {k: part(kind == k) for k in (_UPPER, _DIGIT, _STOP, _SHOUT, _BAR, _SYMBOL, _HIGH, _LOWER)}
    text = np.where(spaces | (data == 10), 32, data)
    first, last = textscan.words(text)
    hashes = textscan.span_hashes(data, first, last)
    line_of = np.searchsorted(start, first, "right") - 1
    words = np.bincount(line_of, minlength=n)
    row_of = np.searchsorted(row_at, first, "right") - 1
    same = np.zeros(len(first), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
    # three words in a row that stood in the document before
    runs = np.zeros(len(first), bool)
    if len(first) > 2:
        triple = textscan.mix(hashes[2:] + hashes[1:-1] * np.uint64(3) + hashes[:-2] * np.uint64(7) + row_of[2:].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(triple, kind="stable")
        repeated = np.zeros(len(triple), bool)
        repeated[order[1:]] = triple[order[1:]] == triple[order[:-1]]
        runs[2:] = repeated & (row_of[2:] == row_of[:-2])
    whole = textscan.span_hashes(data, start, stop) + (np.searchsorted(row_at, start, "right")).astype(np.uint64)
    _, where, times = np.unique(whole, return_inverse=True, return_counts=True)
    marks = np.concatenate(([0], np.cumsum((kind == _SYMBOL) | (kind == _SHOUT) | (kind == _BAR))))
    marked = np.bincount(line_of, (marks[last] > marks[first]), n)
    letters = np.maximum(counts[_UPPER] + counts[_LOWER] + counts[_HIGH], 1)
    rate = np.stack(
        [
            counts[_UPPER] / letters, counts[_DIGIT] / size, counts[_STOP] / size, counts[_SHOUT] / size, counts[_BAR] / size, counts[_SYMBOL] / size,
            marked / np.maximum(words, 1), np.bincount(line_of, same, n) / np.maximum(words, 1), np.bincount(line_of, runs, n) / np.maximum(words, 1),
            (times[where] > 1).astype(float), np.isin(data[stop - 1], list(b".!?:\"')")).astype(float), np.minimum(letters / np.maximum(words, 1) / 20, 1), np.log1p(words) / 6,
        ],
        1,
    )
    return np.concatenate((rate, np.minimum(1, 10 * rate), np.ones((n, 1))), 1), size.astype(float), rows


def joined(texts: list) -> tuple[bytes, np.ndarray]:
    raw = [(t or "").encode() + b"\n" for t in texts]
    return b"".join(raw), np.concatenate(([0], np.cumsum([len(r) for r in raw])))


def with_neighbours(features: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A line's features, those of the line before, and those of the line after (zeros beyond the document)."""
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:], after[:-1] = features[:-1], features[1:]
    heads = rows[:-1][np.diff(rows) > 0]
    tails = rows[1:][np.diff(rows) > 0] - 1
    before[heads], after[tails] = 0, 0
    return np.concatenate((features, before, after), 1)


def marginals(lean: np.ndarray, rows: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(line is bad) by forward-backward, and P(line bad or good, next line bad or good) summed over all lines.

    lean: log potential of bad against good; chain: log potentials [state, next state].
    """
    n = len(lean)
    bad, pairs = np.zeros(n), np.zeros((2, 2))
    if not n:
        return bad, pairs
    top = np.maximum(lean, 0)
    potential = np.stack((np.exp(-top), np.exp(lean - top)), 1)
    step = np.exp(chain - chain.max())
    lengths = np.diff(rows)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    begin, length = rows[:-1][order], lengths[order]
    forward, backward = np.zeros((n, 2)), np.ones((n, 2))
    for t in range(length[0]):
        at = begin[: np.searchsorted(-length, -t)] + t
        now = potential[at] if t == 0 else forward[at - 1] @ step * potential[at]
        forward[at] = now / now.sum(1, keepdims=True)
    for t in range(length[0] - 1, 0, -1):
        at = begin[: np.searchsorted(-length, -t)] + t
        ahead = potential[at] * backward[at]
        both = forward[at - 1][:, :, None] * step * ahead[:, None, :]
        pairs += (both / both.sum((1, 2), keepdims=True)).sum(0)
        now = ahead @ step.T
        backward[at - 1] = now / now.sum(1, keepdims=True)
    gamma = forward * backward
    return gamma[:, 1] / gamma.sum(1), pairs


def descend(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Adam."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for k in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return x


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(texts: list, good: list[int]) -> dict:
    """The field from labelled documents.

    Lines of good documents are good; a bad document's lines are told by a classifier of lines that is fitted
    and asked again in turn, its worst line being bad in any case.  A logistic curve then carries the
    length-weighted bad part of a document over to the probability of its label.
    """
    raw, row_at = joined(texts)
    features, size, rows = line_features(raw, row_at)
    x = with_neighbours(features, rows)
    width = x.shape[1]
    label = np.asarray(good, float)
    doc = np.repeat(np.arange(len(texts)), np.diff(rows))
    if not len(x) or label.min(initial=1) == label.max(initial=0):
        prior = float(label.mean()) if len(label) else 0.5
        return {"weights": np.zeros(width), "chain": np.zeros((2, 2)), "slope": 0.0, "offset": float(np.log((prior + 0.01) / (1.01 - prior)))}
    suspect = label[doc] < 0.5
    target = suspect.astype(float)
    weights = np.zeros(width)
    share = size / np.bincount(doc, size)[doc]  # so that each document counts alike
    for _ in range(4):
        def slope(w, target=target):
            return x.T @ (share * (squash(x @ w) - target)) / len(texts) + 1e-4 * w

        weights = descend(slope, weights, 150, 0.1)
        lean = squash(x @ weights)
        worst = np.zeros(len(texts))
        np.maximum.at(worst, doc, np.where(suspect, lean, 0))
        target = (suspect & ((lean > 0.5) | (lean >= worst[doc]))).astype(float)
    inside = np.flatnonzero(doc[1:] == doc[:-1])
    state = target.astype(int)
    seen = np.zeros((2, 2))
    np.add.at(seen, (state[inside], state[inside + 1]), 1)

    def field(theta):
        bad, pairs = marginals(x @ theta[4:], rows, theta[:4].reshape(2, 2))
        return np.concatenate(((pairs - seen).ravel(), x.T @ (bad - target))) / len(x) + 1e-4 * theta

    theta = descend(field, np.concatenate((np.zeros(4), weights)), 120, 0.05)
    model = {"weights": theta[4:], "chain": theta[:4].reshape(2, 2), "slope": 0.0, "offset": 0.0}
    part = bad_parts(model, features, size, rows)
    z = np.stack((np.ones(len(part)), part), 1)
    balance = np.where(label > 0.5, 0.5 / label.mean(), 0.5 / (1 - label.mean()))
    offset, slope_ = descend(lambda w: z.T @ (balance * (squash(z @ w) - label)) / len(label) + 1e-4 * w, np.array([2.0, -6.0]), 400, 0.1)
    return model | {"slope": float(slope_), "offset": float(offset)}


def bad_parts(model: dict, features: np.ndarray, size: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The part of each document's bytes that lies in bad lines, by marginals; 1 for documents without a line."""
    bad, _ = marginals(with_neighbours(features, rows) @ model["weights"], rows, model["chain"])
    total = np.concatenate(([0], np.cumsum(size)))
    lost = np.concatenate(([0], np.cumsum(size * bad)))
    all_bytes = total[rows[1:]] - total[rows[:-1]]
    return np.where(all_bytes > 0, (lost[rows[1:]] - lost[rows[:-1]]) / np.maximum(all_bytes, 1), 1.0)


def labelled_sample(documents: DataFrame, labels: DataFrame, column: str, apart, docs: int, most_bytes: int) -> list:
    """(text, label) of at most docs documents that are not held out, half of each class where there are as many.

    labels and sample are joined by doc_id after the sample of labels, which is bounded, is chosen by hash.  Of a text of
    more than most_bytes bytes a window of half as many characters is learned from, at a place that its doc_id names.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~apart).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("label"))
    order = F.xxhash64("doc_id")
    picked = usable.where("label = 1").orderBy(order).limit(docs // 2).unionAll(usable.where("label = 0").orderBy(order).limit(docs // 2))
    size, width = F.octet_length("text"), most_bytes // 2
    begin = (F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - width + 1, F.lit(1))) + 1).cast("int")
    window = F.when(size <= most_bytes, F.col("text")).otherwise(F.substr("text", begin, F.lit(width)))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(size > 0).join(F.broadcast(picked), "doc_id").select("doc_id", window.alias("text"), "label")
    return [(r["text"], r["label"]) for r in sorted(rows.collect(), key=lambda r: (r["doc_id"], r["text"]))]


def _fitted(documents: DataFrame, labels: DataFrame, docs: int, most_bytes: int):
    sample = labelled_sample(documents, labels, "quality", held_out(), docs, most_bytes)
    return documents.sparkSession.sparkContext.broadcast(fit([t for t, _ in sample], [g for _, g in sample]))


def _scored(batches, shared):
    """(rows, their scores), some rows at a time."""
    model = shared.value
    for batch in batches:
        for begin, end in textscan.blocks(batch["text"]):
            part = batch.slice(begin, end - begin)
            raw, row_at = joined(part["text"].to_pylist())
            yield part, squash(model["offset"] + model["slope"] * bad_parts(model, *line_features(raw, row_at)))


def score(documents: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null, empty and blank texts score as wholly bad.  Repeated rows score alike; a
    null doc_id is not held out; an empty table gives no rows; without labels of both classes every text
    scores their smoothed mean.  Columns other than doc_id and text are not read, and
    of labels only doc_id and quality.
    """
    shared = _fitted(documents, labels, sample_docs, sample_bytes)

    def run(batches):
        for part, result in _scored(batches, shared):
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(result), pa.array(result >= GOOD_SCORE).cast(pa.int32())], names=["doc_id", "score", "predicted"])

    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int").select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(documents: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """The documents whose score is at least GOOD_SCORE, with all their columns, in the one pass that scores them."""
    shared = _fitted(documents, labels, sample_docs, sample_bytes)

    def run(batches):
        for part, result in _scored(batches, shared):
            yield part.filter(pa.array(result >= GOOD_SCORE))

    return documents.mapInArrow(run, documents.schema)
