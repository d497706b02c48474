"""Small decision trees for bounded training sets on the driver: a forest and gradient boosting.

Features are binned at quantiles; a tree is a list of (feature, threshold, left,
right, value) rows, so that it can be written as a Spark expression or applied to
arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    feature: list[int]
    cut: list[float]
    left: list[int]
    right: list[int]
    value: list[float]

    def apply(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        feature, cut, left, right, value = map(np.array, (self.feature, self.cut, self.left, self.right, self.value))
        for _ in range(len(value)):
            inner = feature[at] >= 0
            if not inner.any():
                break
            go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
            at = np.where(inner, np.where(go, left[at], right[at]), at)
        return value[at]


def grow(x: np.ndarray, target: np.ndarray, weight: np.ndarray, depth: int, least: float, pick: int | None = None, rng=None, penalty: float = 1e-9) -> Tree:
    """The tree of least squares of target / weight: a leaf's value is sum(target) / (sum(weight) + penalty)."""
    t = Tree([], [], [], [], [])

    def node(rows: np.ndarray, d: int) -> int:
        me = len(t.value)
        g, h = target[rows].sum(), weight[rows].sum()
        for part, v in ((t.feature, -1), (t.cut, 0.0), (t.left, -1), (t.right, -1), (t.value, float(g / (h + penalty)))):
            part.append(v)
        if d == 0 or h < 2 * least:
            return me
        best = (1e-9, -1, 0.0)
        features = range(x.shape[1]) if pick is None else rng.choice(x.shape[1], pick, replace=False)
        for f in features:
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, gs, hs = x[order, f], np.cumsum(target[order]), np.cumsum(weight[order])
            ok = np.flatnonzero((v[1:] > v[:-1] + 1e-9) & (hs[:-1] >= least) & (h - hs[:-1] >= least))
            if len(ok):
                gain = gs[ok] ** 2 / (hs[ok] + penalty) + (g - gs[ok]) ** 2 / (h - hs[ok] + penalty) - g * g / (h + penalty)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), int(f), float((v[ok[k]] + v[ok[k] + 1]) / 2))
        if best[1] < 0:
            return me
        go = x[rows, best[1]] <= best[2]
        t.feature[me], t.cut[me] = best[1], best[2]
        t.left[me] = node(rows[go], d - 1)
        t.right[me] = node(rows[~go], d - 1)
        return me

    node(np.arange(len(x)), depth)
    return t


def forest(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int = 6) -> list[Tree]:
    """Each tree sees a bootstrap sample and, at each node, some of the features; leaves hold the share of label 1."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        w = np.bincount(rng.integers(0, len(x), len(x)), minlength=len(x)).astype(float)
        out.append(grow(x, y * w, w, depth, 2.0, max(1, round(x.shape[1] ** 0.5) + 1), rng))
    return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int, depth: int, rate: float = 0.2) -> tuple[float, list[Tree]]:
    """Second-order boosting of the logistic loss: (first log odds, trees whose values are to be added)."""
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    s, out = np.full(len(x), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-s))
        t = grow(x, y - p, p * (1 - p), depth, 1.0, penalty=1.0)
        t.value = [rate * v for v in t.value]
        s += t.apply(x)
        out.append(t)
    return base, out
