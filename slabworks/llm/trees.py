"""Gradient-boosted trees for small samples, scored on numpy node arrays, with monotonic constraints."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees' nodes in flat arrays: inner nodes go left if value <= threshold; leaves have feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row: all rows step down all trees together."""
        node = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[node]
            go_left = x[rows, np.maximum(f, 0)] <= self.threshold[node]
            node = np.where(f < 0, node, np.where(go_left, self.left[node], self.right[node]))
        return self.base + self.value[node].sum(axis=1)

    def lowest(self, low: np.ndarray, high: np.ndarray) -> float:
        """No row with low <= x <= high scores less than this: the sum of each tree's lowest reachable leaf."""

        def reach(node: int) -> float:
            f = self.feature[node]
            if f < 0:
                return float(self.value[node])
            found = []
            if low[f] <= self.threshold[node]:
                found.append(reach(self.left[node]))
            if high[f] > self.threshold[node]:
                found.append(reach(self.right[node]))
            return min(found)

        return self.base + sum(reach(int(r)) for r in self.roots)


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, leaf: int = 5, ridge: float = 1.0) -> Forest:
    """Boosted trees on logistic loss; monotone is 1 where the score may only rise with a feature, else 0.

    A constrained split keeps its left value below its right one, and the middle between the two bounds
    what the subtrees may say, so every tree and their sum are monotonic.
    """
    n, k = x.shape if x.ndim == 2 else (0, len(monotone))
    share = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(k)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if n else np.zeros((0, k), dtype=int)
    f = np.full(n, base)

    def weight(g: float, h: float, lo: float, hi: float) -> float:
        return float(np.clip(-g / (h + ridge), lo, hi))

    def grow(idx: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, lo: float, hi: float) -> int:
        me = len(nodes)
        gs, hs = g[idx].sum(), h[idx].sum()
        nodes.append([-1, 0.0, -1, -1, rate * weight(gs, hs, lo, hi)])
        if level == 0 or len(idx) < 2 * leaf:
            return me
        best = (1e-6, None)
        gain_of = lambda gg, hh, w: -(gg * w + 0.5 * (hh + ridge) * w * w)
        whole = gain_of(gs, hs, weight(gs, hs, lo, hi))
        for j in range(k):
            m = len(edges[j]) + 1
            if m < 2:
                continue
            c = code[idx, j]
            gl, hl, nl = (np.cumsum(np.bincount(c, w, m))[:-1] for w in (g[idx], h[idx], np.ones(len(idx))))
            wl, wr = np.clip(-gl / (hl + ridge), lo, hi), np.clip(-(gs - gl) / (hs - hl + ridge), lo, hi)
            gain = gain_of(gl, hl, wl) + gain_of(gs - gl, hs - hl, wr) - whole
            ok = (nl >= leaf) & (len(idx) - nl >= leaf)
            if monotone[j]:
                ok &= wl <= wr
            gain = np.where(ok, gain, -np.inf)
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], (j, at, wl[at], wr[at]))
        if best[1] is None:
            return me
        j, at, wl, wr = best[1]
        go = code[idx, j] <= at
        mid = (wl + wr) / 2
        left = grow(idx[go], g, h, level - 1, lo, mid if monotone[j] else hi)
        right = grow(idx[~go], g, h, level - 1, mid if monotone[j] else lo, hi)
        nodes[me] = [j, float(edges[j][at]), left, right, 0.0]
        return me

    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        first = len(nodes)
        roots.append(grow(np.arange(n), g, h, depth, -np.inf, np.inf))
        t = np.array(nodes[first:], dtype=float)
        one = Forest(t[:, 0].astype(int), t[:, 1], t[:, 2].astype(int) - first, t[:, 3].astype(int) - first, t[:, 4], np.array([0]), 0.0, depth)
        f = f + one.score(x)
    t = np.array(nodes, dtype=float) if nodes else np.array([[-1, 0, -1, -1, 0.0]])
    return Forest(t[:, 0].astype(np.int32), t[:, 1], t[:, 2].astype(np.int32), t[:, 3].astype(np.int32), t[:, 4], np.array(roots or [0], dtype=np.int32), base, depth)
