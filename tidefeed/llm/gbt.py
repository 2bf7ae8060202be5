"""Histogram gradient-boosted trees: a small trainer and flattened scoring arrays.

Training works on one bounded sample (rows x features in numpy).  Every tree is
appended to flat node arrays (feature, threshold, left, right, value), so scoring
is a few vectorised gathers per tree level with no per-row Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class FlatTrees:
    """Trees as node arrays.  A leaf has feature -1 and points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of leaf values (log-odds) for each row of ``x``."""
        if not len(self.roots) or not len(x):
            return np.full(len(x), self.base)
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            feature = self.feature[node]
            goes_left = x[rows, np.maximum(feature, 0)] <= self.threshold[node]
            node = np.where(feature < 0, node, np.where(goes_left, self.left[node], self.right[node]))
        return self.base + self.value[node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -40, 40)))


@dataclass(frozen=True)
class Params:
    trees: int = 60
    depth: int = 4
    bins: int = 64
    rate: float = 0.2
    l2: float = 1.0
    min_rows: int = 8


def bin_edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Upper edges that cut a column into at most ``bins`` groups of similar size."""
    values = np.unique(column)
    if len(values) <= bins:
        return (values[:-1] + values[1:]) / 2
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def train(x: np.ndarray, y: np.ndarray, params: Params = Params(),
          monotone: dict[int, int] | None = None) -> FlatTrees:
    """Fit logistic-loss trees.

    ``monotone`` maps a column to +1 (score may only rise with it) or -1 (only
    fall).  A split that breaks the direction is refused, and each child's leaf
    values are held on its side of the split's midpoint, so the whole ensemble is
    monotone in that column.  With no rows, or rows of one label only, the result
    is a constant (0.5 without rows).
    """
    monotone = monotone or {}
    n = len(y)
    positives = float(y.sum()) if n else 0.0
    if not n or positives in (0.0, float(n)):
        base = 0.0 if not n else (4.0 if positives else -4.0)
        empty = np.zeros(0)
        return FlatTrees(empty.astype(int), empty, empty.astype(int), empty.astype(int), empty,
                         empty.astype(int), 0, base)
    edges = [bin_edges(x[:, j], params.bins) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    width = max(len(e) for e in edges) + 1
    offsets = np.arange(x.shape[1]) * width
    base = float(np.log(positives / (n - positives)))
    margin = np.full(n, base)
    nodes: list[list[float]] = []
    roots = []

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + params.l2), low, high))

    def grow(rows: np.ndarray, level: int, low: float, high: float, grad: np.ndarray, hess: np.ndarray) -> int:
        at = len(nodes)
        total_g, total_h = grad[rows].sum(), hess[rows].sum()
        nodes.append([-1, 0.0, at, at, params.rate * leaf(total_g, total_h, low, high)])
        if level == params.depth or len(rows) < 2 * params.min_rows:
            return at
        flat = (binned[rows] + offsets).ravel()
        size = width * x.shape[1]
        g, h, c = (np.bincount(flat, np.repeat(w, x.shape[1]), size).reshape(-1, width).cumsum(axis=1)
                   for w in (grad[rows], hess[rows], np.ones(len(rows))))
        rg, rh, rc = total_g - g, total_h - h, len(rows) - c
        gain = g * g / (h + params.l2) + rg * rg / (rh + params.l2) - total_g ** 2 / (total_h + params.l2)
        gain[(c < params.min_rows) | (rc < params.min_rows)] = -1.0
        lv = np.clip(-g / (h + params.l2), low, high)
        rv = np.clip(-rg / (rh + params.l2), low, high)
        for j, way in monotone.items():
            gain[j, (rv[j] - lv[j]) * way < 0] = -1.0
        for j, e in enumerate(edges):
            gain[j, len(e):] = -1.0
        j, b = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[j, b] <= 1e-9:
            return at
        mid = (lv[j, b] + rv[j, b]) / 2
        way = monotone.get(int(j), 0)
        left_box = (low, mid) if way > 0 else (mid, high) if way < 0 else (low, high)
        right_box = (mid, high) if way > 0 else (low, mid) if way < 0 else (low, high)
        goes_left = binned[rows, j] <= b
        left = grow(rows[goes_left], level + 1, *left_box, grad, hess)
        right = grow(rows[~goes_left], level + 1, *right_box, grad, hess)
        nodes[at] = [int(j), float(edges[j][b]), left, right, 0.0]
        return at

    def frozen() -> FlatTrees:
        table = np.array(nodes)
        return FlatTrees(table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64),
                         table[:, 3].astype(np.int64), table[:, 4], np.array(roots), params.depth, base)

    everything = np.arange(n)
    for _ in range(params.trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        first = len(nodes)
        roots.append(grow(everything, 0, -np.inf, np.inf, p - y, p * (1 - p)))
        tree = np.array(nodes[first:])
        node = np.zeros(n, dtype=np.int64)
        for _ in range(params.depth):
            feature = tree[node, 0].astype(np.int64)
            goes_left = x[everything, np.maximum(feature, 0)] <= tree[node, 1]
            node = np.where(feature < 0, node, np.where(goes_left, tree[node, 2], tree[node, 3]).astype(np.int64) - first)
        margin += tree[node, 4]
    return frozen()
