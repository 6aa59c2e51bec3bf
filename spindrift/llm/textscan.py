"""Vectorised scanning of text: words and their 64-bit hashes without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes of text handled at a time; bounds the temporary arrays to some 40 times that.
BLOCK_BYTES = 2 << 20

SPACE, WORD, MARK, APOSTROPHE = range(4)
CLASS = np.full(256, WORD, np.uint8)
CLASS[:128] = [SPACE if chr(b).isspace() and b not in range(28, 32) else WORD if chr(b).isalnum() else APOSTROPHE if b == 39 else MARK for b in range(128)]
_power = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _power[k] = np.multiply.accumulate(steps)
    return _power[0][:n], _power[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in which every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, alike wherever it stands."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[1:], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs between spaces (byte 32)."""
    full = np.zeros(len(data) + 2, np.int8)
    full[1:-1] = data != 32
    step = np.diff(full)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def units(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches that a word-wise tokenizer handles apart from each other.

    They end at ASCII white space and between word characters and ASCII marks, but
    never beside an apostrophe, which may belong to either side.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = CLASS[data]
    full = kind != SPACE
    cut = (kind[1:] != kind[:-1]) & (kind[1:] != APOSTROPHE) & (kind[:-1] != APOSTROPHE)
    cut |= ~full[1:] | ~full[:-1]
    first, last = np.ones(len(data), bool), np.ones(len(data), bool)
    first[1:] = last[:-1] = cut
    return np.flatnonzero(first & full), np.flatnonzero(last & full) + 1


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about most bytes; one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = 0
    while start < len(sizes):
        end = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), most)))
        yield start, end
        start = end


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (separated by single spaces) of all rows, and where each row's begin: n + 1 offsets."""
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    # a space between rows keeps their words apart
    spaced = np.insert(data, offsets[1:-1], 32) if n > 1 else data
    row_at = offsets + np.arange(n + 1)
    row_at[-1] = len(spaced)
    starts, ends = words(spaced)
    return span_hashes(spaced, starts, ends), np.searchsorted(starts, row_at)


def windows(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each width words in a row, none across rows, and the rows' offsets."""
    n = len(hashes) - width + 1
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    where = np.concatenate(([0], np.cumsum(counts)))
    if n <= 0:
        return np.zeros(0, np.uint64), where
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    keep = np.repeat(offsets[:-1] - where[:-1], counts) + np.arange(where[-1])
    return mix(total[keep]), where


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of the next."""
    before = np.concatenate(([0], np.cumsum(counts)))
    return np.repeat(starts - before[:-1], counts) + np.arange(before[-1])


def in_parts(counts: np.ndarray, most: int):
    """Bounds of runs whose counts sum to about most; one at least."""
    upto, at = np.cumsum(counts), 0
    while at < len(counts):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end
