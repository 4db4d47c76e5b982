"""A small decision tree (Gini splits) trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Node i: feature[i] < 0 is a leaf with value[i]; else go to low[i] or high[i] by x <= cut[i]."""
    feature: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(len(self.feature)):
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                break
            goes_low = x[rows, np.maximum(f, 0)] <= self.cut[node]
            node = np.where(inner, np.where(goes_low, self.low[node], self.high[node]), node)
        return self.value[node]


def best_split(x: np.ndarray, y: np.ndarray, least: int) -> tuple[float, int, float] | None:
    """(impurity, feature, cut) of the best split; ties go to the earlier feature and the lower cut."""
    best, n = None, len(y)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        ones = np.cumsum(t)
        k = np.arange(1, n)
        ok = (v[1:] > v[:-1]) & (k >= least) & (n - k >= least)
        if not ok.any():
            continue
        p, q = ones[:-1] / k, (ones[-1] - ones[:-1]) / (n - k)
        gini = k * p * (1 - p) + (n - k) * q * (1 - q)
        gini[~ok] = np.inf
        i = int(np.argmin(gini))
        if best is None or gini[i] < best[0] - 1e-12:
            best = (float(gini[i]), f, float((v[i] + v[i + 1]) / 2))
    return best


def train_tree(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1) -> Tree:
    """Grow until leaves are pure, ``depth`` is reached or no split is left."""
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, level: int) -> int:
        at = len(nodes)
        mean = float(y[rows].mean())
        nodes.append([-1, 0.0, 0, 0, mean])
        split = best_split(x[rows], y[rows], least) if 0 < mean < 1 and level < depth else None
        if split is not None and split[0] < len(rows) * mean * (1 - mean) - 1e-12:
            _, f, cut = split
            side = x[rows, f] <= cut
            nodes[at][:4] = [f, cut, grow(rows[side], level + 1), grow(rows[~side], level + 1)]
        return at

    grow(np.arange(len(y)), 0)
    a = np.array(nodes)
    return Tree(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4])
