"""Unified diffs of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of the tails a[i:], b[j:], a row of cells at a time."""
    names: dict[str, int] = {}
    x, y = (np.array([names.setdefault(line, len(names)) for line in lines], np.int64) for lines in (a, b))
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        gained = np.where(x[i] == y, table[i + 1, 1:] + 1, table[i + 1, :-1])
        # the best of this row's tails: a running maximum from the right
        table[i, :-1] = np.maximum.accumulate(gained[::-1])[::-1]
    return table


#: Cells of a table of two texts' lines; beyond it the texts are divided.
MOST_CELLS = 1 << 22
#: Rows of an Arrow batch that are held as Python's objects.
HELD_ROWS = 256
#: Edits up to which the shortest script is sought by them.
MOST_EDITS = 2000


def best_row(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of all of x with each y[:j]; two rows are held at a time."""
    row = np.zeros(len(y) + 1, np.int32)
    for value in x:
        gained = np.maximum(row[1:], np.where(y == value, row[:-1] + 1, 0))
        row[1:] = np.maximum.accumulate(gained)
    return row


def few_edits(x: np.ndarray, y: np.ndarray, most: int = MOST_EDITS) -> list[tuple[int, int]] | None:
    """Places of a longest common subsequence by the greedy shortest edit script, or None where it takes more than most edits.

    All diagonals of one number of edits go forward together; how far lines stay equal is found by halving over prefix hashes.
    """
    n, m = len(x), len(y)
    codes = np.random.default_rng(1).integers(1, 1 << 62, int(max(x.max(), y.max())) + 1).astype(np.uint64)
    powers = np.ones(max(n, m) + 1, np.uint64)
    powers[1:] = np.multiply.accumulate(np.full(max(n, m), 0x9E3779B97F4A7C15, np.uint64))
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes[z] * powers[: len(z)], dtype=np.uint64))) for z in (x, y)]

    def run(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(i), np.int64), np.minimum(n - i, m - j)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = (sums[0][i + mid] - sums[0][i]) * powers[j] == (sums[1][j + mid] - sums[1][j]) * powers[i]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    far, trace, zero = np.full(2 * most + 5, -1, np.int64), [], most + 2
    far[zero + 1] = 0
    for d in range(most + 1):
        trace.append(far[zero - d - 1 : zero + d + 2].copy())
        k = np.arange(-d, d + 1, 2)
        down = (k == -d) | ((k != d) & (far[zero + k - 1] < far[zero + k + 1]))
        i = np.where(down, far[zero + k + 1], far[zero + k - 1] + 1)
        good = (i >= 0) & (i <= n) & (i - k >= 0) & (i - k <= m)
        i[good] += run(i[good], (i - k)[good])
        far[zero + k] = np.where(good, i, -1 << 40)
        if (end := np.flatnonzero((k == n - m) & good & (i == n))).size:
            break
    else:
        return None
    out, i, j = [], n, m
    for d in range(len(trace) - 1, -1, -1):
        held = lambda k, d=d: trace[d][k + d + 1]
        k = i - j
        before = k + 1 if k == -d or (k != d and held(k - 1) < held(k + 1)) else k - 1
        from_i = int(held(before))
        first = from_i if before == k + 1 else from_i + 1
        out += [(a, a - k) for a in range(i - 1, first - 1, -1)]
        i, j = from_i, from_i - before
    out.reverse()
    return out if all(x[a] == y[b] for a, b in out) else None


def matched(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence, in order; memory grows with the lines, not with their product.

    Equal beginnings and ends are taken off; what few edits do not lead to is halved in x where the best of both halves' tables meet, until a table is small.
    """
    out: list[tuple[int, int]] = []
    stack: list[tuple[int, int, int, int]] = [(0, len(x), 0, len(y))]
    while stack:
        i, i_end, j, j_end = stack.pop()
        while i < i_end and j < j_end and x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and x[i_end - 1] == y[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        if (i_end - i) * (j_end - j) <= MOST_CELLS or i_end - i == 1:
            table = common_lengths(x[i:i_end].tolist(), y[j:j_end].tolist())
            at, to = 0, 0
            while at < i_end - i and to < j_end - j:
                if x[i + at] == y[j + to]:
                    out.append((i + at, j + to))
                    at, to = at + 1, to + 1
                elif table[at + 1, to] >= table[at, to + 1]:
                    at += 1
                else:
                    to += 1
            continue
        if (found := few_edits(x[i:i_end], y[j:j_end])) is not None:
            out += [(i + p, j + q) for p, q in found]
            continue
        half = (i + i_end) // 2
        front, back = best_row(x[i:half], y[j:j_end]), best_row(x[half:i_end][::-1], y[j:j_end][::-1])[::-1]
        cut = j + int(np.argmax(front + back))
        stack += [(half, i_end, cut, j_end), (i, half, j, cut)]
    return sorted(out)


def long_script(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """script() of long texts: lines that the other text has not are set aside, the rest is matched in linear space."""
    names: dict[str, int] = {}
    x, y = (np.array([names.setdefault(line, len(names)) for line in lines], np.int64) for lines in (a, b))
    in_b, in_a = np.flatnonzero(np.isin(x, y)), np.flatnonzero(np.isin(y, x))
    out, i, j = [], 0, 0
    for p, q in [*((int(in_b[p]), int(in_a[q])) for p, q in matched(x[in_b], y[in_a])), (len(a), len(b))]:
        out += [("-", line) for line in a[i:p]] + [("+", line) for line in b[j:q]]
        if p < len(a):
            out.append((" ", a[p]))
        i, j = p + 1, q + 1
    return out


def script(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """(sign, line) that lead from a to b over a longest common subsequence; removals come before additions."""
    if (len(a) + 1) * (len(b) + 1) > MOST_CELLS:
        return long_script(a, b)
    table, out, i, j = common_lengths(a, b), [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((" ", a[i]))
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            out.append(("-", a[i]))
            i += 1
        else:
            out.append(("+", b[j]))
            j += 1
    return out + [("-", line) for line in a[i:]] + [("+", line) for line in b[j:]]


def unified(old: str, new: str, context: int = 3, names: tuple[str, str] = ("a", "b")) -> str:
    """A unified diff; empty for equal texts.  Changes at most twice the context apart share a hunk."""
    steps = script(old.split("\n") if old else [], new.split("\n") if new else [])
    changed = [n for n, (sign, _) in enumerate(steps) if sign != " "]
    if not changed:
        return ""
    hunks = [[changed[0], changed[0]]]
    for n in changed[1:]:
        if n - hunks[-1][1] - 1 < 2 * context:
            hunks[-1][1] = n
        else:
            hunks.append([n, n])
    out, a, b, at = [f"--- {names[0]}", f"+++ {names[1]}"], 1, 1, 0
    for first, last in hunks:
        begin, end = max(first - context, at), min(last + 1 + context, len(steps))
        a, b = (x + sum(sign in kinds for sign, _ in steps[at:begin]) for x, kinds in ((a, " -"), (b, " +")))
        part = steps[begin:end]
        size = [sum(sign in kinds for sign, _ in part) for kinds in (" -", " +")]
        out.append(f"@@ -{a},{size[0]} +{b},{size[1]} @@")
        out += [sign + line for sign, line in part]
        a, b, at = a + size[0], b + size[1], end
    return "\n".join(out) + "\n"


@F.arrow_udf(T.StringType())
def unified_diff(old: pa.Array, new: pa.Array) -> pa.Array:
    """Unified diffs of two text columns; null counts as empty.  A few rows at a time are held as Python's texts."""
    parts = range(0, len(old), HELD_ROWS)
    done = [pa.array([unified(x or "", y or "") for x, y in zip(old[k : k + HELD_ROWS].to_pylist(), new[k : k + HELD_ROWS].to_pylist(), strict=True)], pa.string()) for k in parts]
    return pa.concat_arrays(done) if done else pa.array([], pa.string())
