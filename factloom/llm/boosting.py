"""Gradient-boosted trees for the log-odds of a binary label, on small training sets."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """Nodes in heap order: the children of k are 2k + 1 and 2k + 2; a leaf has the feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at]
            right = x[np.arange(len(x)), np.maximum(f, 0)] > self.cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)


@dataclass
class Boosted:
    base: float
    rate: float
    trees: list[Tree] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(x)))


def _best(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], l2: float, least: float) -> tuple[float, int, float]:
    top = (1e-9, -1, 0.0)
    whole = g.sum() ** 2 / (h.sum() + l2)
    for f, c in enumerate(cuts):
        if not len(c):
            continue
        bins = np.searchsorted(c, x[:, f], "left")
        gl, hl = np.cumsum(np.bincount(bins, g, len(c) + 1))[:-1], np.cumsum(np.bincount(bins, h, len(c) + 1))[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + l2) + gr**2 / (hr + l2) - whole, -1)
        k = int(gain.argmax())
        if gain[k] > top[0]:
            top = (float(gain[k]), f, float(c[k]))
    return top


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, l2: float = 1.0, least: float = 1.0) -> Boosted:
    """Second-order boosting of the logistic loss; cuts lie at the distinct values or their 32-quantiles."""
    cuts = []
    for f in range(x.shape[1]):
        u = np.unique(x[:, f])
        u = u if len(u) <= 33 else np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)))
        cuts.append((u[:-1] + u[1:]) / 2)
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    model = Boosted(float(np.log(share / (1 - share))), rate)
    z = np.full(len(x), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        size = 2 ** (depth + 1) - 1
        t = Tree(np.full(size, -1), np.zeros(size), np.zeros(size))
        rows = {0: np.arange(len(x))}
        for k in range(size):
            if k not in rows:
                continue
            r = rows.pop(k)
            t.value[k] = -g[r].sum() / (h[r].sum() + l2)
            if 2 * k + 2 >= size:
                continue
            _, f, c = _best(x[r], g[r], h[r], cuts, l2, least)
            if f >= 0:
                t.feature[k], t.cut[k] = f, c
                right = x[r, f] > c
                rows[2 * k + 1], rows[2 * k + 2] = r[~right], r[right]
        model.trees.append(t)
        z += rate * t.predict(x)
    return model
