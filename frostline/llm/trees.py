"""Gradient-boosted trees over a few numeric columns: fitted in numpy, kept as flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Nodes of all trees in arrays; a leaf points to itself.  ``roots`` has each tree's first node."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row: all rows walk down all trees together, a level a step."""
        out = np.full(len(x), self.start)
        for a in range(0, len(x), 4096):
            rows = x[a : a + 4096]
            at = np.broadcast_to(self.roots, (len(rows), len(self.roots))).copy()
            index = np.arange(len(rows))[:, None]
            for _ in range(self.depth):
                at = np.where(rows[index, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            out[a : a + 4096] += self.value[at].sum(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least_weight: float = 3.0, ridge: float = 1.0) -> Trees:
    """Log-loss boosting on binned columns.

    ``monotone`` has 1 (score may only rise with the column), -1 or 0 for each column: a split that goes
    against it isn't made, and the halves' values are kept on their sides of their middle further down.
    Rows of one class, or none, give trees without splits and the class's smoothed odds.
    """
    n, m = x.shape
    p = (y.sum() + 1) / (n + 2)
    start = float(np.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if n else np.zeros(0) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(m)], 1) if n else np.zeros((0, m), int)
    margin = np.full(n, start)
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        k = len(feature)
        feature.append(0), cut.append(np.inf), left.append(k), right.append(k), value.append(rate * v)
        return k

    def best_value(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + ridge), low, high))

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, level: int) -> int:
        own = best_value(g[rows].sum(), h[rows].sum(), low, high)
        k = leaf(own)
        if level == depth or len(rows) < 2:
            return k
        gs, hs = g[rows].sum(), h[rows].sum()
        cost = lambda a, b, v: a * v + 0.5 * (b + ridge) * v * v
        found = (1e-6, -1, 0, 0.0, 0.0)
        for j in range(m):
            if not len(cuts[j]):
                continue
            b = binned[rows, j]
            gl = np.bincount(b, g[rows], len(cuts[j]) + 1).cumsum()[:-1]
            hl = np.bincount(b, h[rows], len(cuts[j]) + 1).cumsum()[:-1]
            vl = np.clip(-gl / (hl + ridge), low, high)
            vr = np.clip(-(gs - gl) / (hs - hl + ridge), low, high)
            gain = cost(gs, hs, own) - cost(gl, hl, vl) - cost(gs - gl, hs - hl, vr)
            gain[(hl < least_weight * 0.25) | (hs - hl < least_weight * 0.25) | (monotone[j] * (vr - vl) < 0)] = -1
            t = int(gain.argmax())
            if gain[t] > found[0]:
                found = (gain[t], j, t, vl[t], vr[t])
        _, j, t, vl, vr = found
        if j < 0:
            return k
        middle, under = (vl + vr) / 2, binned[rows, j] <= t
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[int(monotone[j])]
        feature[k], cut[k] = j, cuts[j][t]
        left[k] = grow(rows[under], g, h, *bounds[0], level + 1)
        right[k] = grow(rows[~under], g, h, *bounds[1], level + 1)
        return k

    for _ in range(trees if 0 < y.sum() < n else 0):
        q = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(n), q - y, np.maximum(q * (1 - q), 1e-6), -np.inf, np.inf, 0))
        one = Trees(*(np.array(v) for v in (feature, cut, left, right, value)), np.array(roots[-1:]), 0.0, depth)
        margin += one.margin(x)
    if not roots:
        roots.append(leaf(0.0))
    return Trees(*(np.array(v) for v in (feature, cut, left, right, value)), np.array(roots), start, depth)
