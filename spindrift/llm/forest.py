"""A random forest of classification trees on numeric features, grown from sums over rows that may lie anywhere."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from spindrift.llm.textscan import mix

#: A row's weight of one, in whole numbers, so that sums are the same in any order.
ONE = 1 << 16
#: How often a bootstrap sample of very many rows takes one row: Poisson's distribution of mean one, summed.
_TIMES = np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 9)]))


def coarse(x: np.ndarray) -> np.ndarray:
    """Numbers rounded to ten binary digits behind the first: few distinct ones, in which quantiles are counted exactly."""
    bits = np.ascontiguousarray(x, np.float32).view(np.uint32)
    return ((bits + np.uint32(0x1000)) & np.uint32(0xFFFFE000)).view(np.float32) + np.float32(0)


def edges_of(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """The quantiles of one feature that part it into bins, from its values and their weights."""
    order = np.argsort(values, kind="stable")
    total = np.cumsum(weights[order])
    return np.unique(values[order][np.searchsorted(total, np.linspace(0, 1, bins + 1)[1:-1] * total[-1])]).astype(np.float32)


class Forest:
    """Trees grown on bootstrap samples; each split takes the best of a random part of the features by Gini impurity.

    All trees grow by one level at a time.  A level needs, of each open node, only the weights of its rows by feature
    and bin: these are sums, taken where the rows are.
    """

    def __init__(self, trees: int = 40, depth: int = 9, least: int = 2, bins: int = 32, seed: int = 3):
        self.trees, self.depth, self.least, self.bins, self.seed = trees, depth, least, bins, seed
        self.made: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Forest:
        """From rows at hand."""
        weight = np.full(len(x), ONE, np.int64) if weight is None else weight
        near, seeds = coarse(x), mix(np.arange(1, len(x) + 1, dtype=np.uint64))
        edges = [edges_of(column, weight, self.bins) for column in near.T]
        return self.grow(edges, lambda opened: self.splits(*self.sums(self.codes(x), y, weight, seeds, opened)))

    def grow(self, edges: list[np.ndarray], splits_of: Callable) -> Forest:
        """Level by level; splits_of tells of the open nodes (trees, nodes, features drawn) what splits() does."""
        rng = np.random.default_rng(self.seed)
        self.edges = edges
        some = max(1, int(np.sqrt(len(edges)) + 1))
        growing = [([-1], [0], [0], [0.0]) for _ in range(self.trees)]
        opened = [(t, 0) for t in range(self.trees)]
        for _ in range(self.depth):
            if not opened:
                break
            self.made = [tuple(map(np.array, tree)) for tree in growing]
            drawn = np.stack([rng.choice(len(edges), some, replace=False) for _ in opened])
            found = splits_of((*np.array(opened).T, drawn))
            after = []
            for (t, node), features, (slot, at, n, p, left_n, left_p) in zip(opened, drawn, found.tolist(), strict=True):
                feature, cut, left, value = growing[t]
                value[node] = p / n if n else 0.0
                if slot < 0 or p in (0, n):
                    continue
                feature[node], cut[node], left[node] = int(features[slot]), at, len(feature)
                for size, good in ((left_n, left_p), (n - left_n, p - left_p)):
                    if size >= 2 * self.least * ONE and 0 < good < size:
                        after.append((t, len(feature)))
                    feature.append(-1), cut.append(0), left.append(0), value.append(good / size)
            opened = after
        self.made = [tuple(map(np.array, tree)) for tree in growing]
        return self

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, np.asarray(x, np.float32).T, strict=True)], 1)

    def reached(self, tree: int, codes: np.ndarray) -> np.ndarray:
        """The node of a tree at which each row ends."""
        feature, cut, left, _ = self.made[tree]
        at = np.zeros(len(codes), np.int64)
        for _ in range(self.depth):
            inner = feature[at] >= 0
            if not inner.any():
                break
            at = np.where(inner, left[at] + (codes[np.arange(len(codes)), np.maximum(feature[at], 0)] > cut[at]), at)
        return at

    def sums(self, codes: np.ndarray, y: np.ndarray, weight: np.ndarray, seeds: np.ndarray, opened: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Of each open node, feature drawn and bin: the weight of all rows and of those that y marks.

        How often a tree's bootstrap sample holds a row follows from the row's seed.
        """
        trees, nodes, drawn = opened
        some = drawn.shape[1]
        shape = (len(nodes), some, self.bins)
        n, p = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        for t in np.unique(trees):
            mine = np.flatnonzero(trees == t)
            place = np.full(len(self.made[t][0]), -1)
            place[nodes[mine]] = np.arange(len(mine))
            draw = (mix(seeds + np.uint64(0x9E3779B97F4A7C15 * (int(t) + 1) % 2**64)) >> np.uint64(11)) * 2.0**-53
            w = weight * np.searchsorted(_TIMES, draw, "right")
            k = place[self.reached(t, codes)]
            rows = np.flatnonzero((k >= 0) & (w > 0))
            k, w = k[rows], w[rows]
            cells = ((k[:, None] * some + np.arange(some)) * self.bins + codes[rows[:, None], drawn[mine][k]]).ravel()
            # whole numbers below 2**53 are exact in double precision
            for out, part in ((n, w), (p, w * y[rows])):
                out[mine] = np.bincount(cells, np.repeat(part, some), len(mine) * some * self.bins).reshape(-1, *shape[1:])
        return n, p

    def splits(self, n: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Of each node: the feature's place among those drawn (-1: no split), the cut, weight, marked weight, and both of the left part."""
        a, q = np.cumsum(n, 2)[:, :, :-1], np.cumsum(p, 2)[:, :, :-1]
        size, marked = n[:, :1].sum(2)[:, :, None], p[:, :1].sum(2)[:, :, None]
        b, r = size - a, marked - q
        good = (a >= self.least * ONE) & (b >= self.least * ONE)
        gini = np.where(good, q * (1 - q / np.maximum(a, 1)) + r * (1 - r / np.maximum(b, 1)), np.inf).reshape(len(n), -1)
        best = gini.argmin(1) if len(n) else np.zeros(0, np.int64)
        rows = np.arange(len(n))
        slot, cut = np.divmod(best, self.bins - 1)
        return np.stack((np.where(good.reshape(len(n), -1)[rows, best], slot, -1), cut, size[:, 0, 0], marked[:, 0, 0], a[rows, slot, cut], q[rows, slot, cut]), 1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        codes = self.codes(x)
        total = np.zeros(len(x))
        for tree, (*_, value) in enumerate(self.made):
            total += value[self.reached(tree, codes)]
        return total / max(1, len(self.made))
