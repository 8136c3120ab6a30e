"""Histogram gradient-boosted trees in numpy: binned fitting, trees flattened to arrays, vectorised traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Trees as arrays [tree, node]; a leaf points at itself, so a fixed number of steps ends every traversal."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """[rows, features] -> log odds; a row's traversals of all trees advance together."""
        trees = np.arange(len(self.feature))[None, :]
        rows = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), dtype=np.int32)
        for _ in range(self.depth):
            goes_left = x[rows, self.feature[trees, node]] <= self.threshold[trees, node]
            node = np.where(goes_left, self.left[trees, node], self.right[trees, node])
        return self.base + self.value[trees, node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 10) -> Forest:
    """Logistic boosting. Features are cut at quantiles into `bins` bins; each level picks each node's best histogram split.

    No rows, or one class only, give trees without splits, so that every score is the smoothed base rate.
    """
    n, m = x.shape
    rate0 = (y.sum() + 1.0) / (n + 2.0)
    base = float(np.log(rate0 / (1 - rate0)))
    size = 2 ** (depth + 1) - 1
    feature = np.zeros((trees, size), dtype=np.int32)
    threshold = np.full((trees, size), np.inf)
    left = np.tile(np.arange(size, dtype=np.int32), (trees, 1))
    right = left.copy()
    value = np.zeros((trees, size))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for f in range(m)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(m)]) if n else np.zeros((m, 0), int)
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        open_nodes = [0]
        for level in range(depth + 1):
            if not open_nodes:
                break
            first, width = 2**level - 1, 2**level
            inside = node >= first
            slot = node[inside] - first
            gs, hs = np.bincount(slot, g[inside], width), np.bincount(slot, h[inside], width)
            cs = np.bincount(slot, minlength=width)
            value[t, first : first + width] = np.where(cs > 0, rate * gs / (hs + l2), 0)
            if level == depth:
                break
            best = np.full(width, 1e-6)
            where = np.full((width, 2), -1)
            for f in range(m):
                if not len(cuts[f]):
                    continue
                k = len(cuts[f]) + 1
                cell = slot * k + binned[f][inside]
                gh = np.bincount(cell, g[inside], width * k).reshape(width, k).cumsum(1)[:, :-1]
                hh = np.bincount(cell, h[inside], width * k).reshape(width, k).cumsum(1)[:, :-1]
                ch = np.bincount(cell, minlength=width * k).reshape(width, k).cumsum(1)[:, :-1]
                gain = gh**2 / (hh + l2) + (gs[:, None] - gh) ** 2 / (hs[:, None] - hh + l2) - (gs**2 / (hs + l2))[:, None]
                gain[(ch < least) | (cs[:, None] - ch < least)] = -1
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better], where[better, 0], where[better, 1] = top[better], f, at[better]
            split = [s for s in range(width) if where[s, 0] >= 0]
            for s in split:
                i = first + s
                f, b = where[s]
                feature[t, i], threshold[t, i] = f, cuts[f][b]
                left[t, i], right[t, i] = 2 * i + 1, 2 * i + 2
            go = np.zeros(n, dtype=bool)
            go[inside] = np.isin(slot, split)
            at = np.flatnonzero(go)
            i = node[at]
            goes_left = x[at, feature[t, i]] <= threshold[t, i]
            node[at] = np.where(goes_left, 2 * i + 1, 2 * i + 2)
            open_nodes = split
        margin += value[t, node]
    return Forest(feature, threshold, left, right, value, base, depth)
