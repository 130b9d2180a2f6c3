"""Gradient-boosted trees with monotonic constraints, trained and scored in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees in flat node arrays; a leaf is its own child, so a walk of ``depth`` steps ends in a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def constant(p: float) -> Forest:
    """A forest that gives every row the same probability."""
    zero = np.zeros(1, np.int64)
    p = min(max(p, 1e-6), 1 - 1e-6)
    return Forest(zero, np.zeros(1), zero, zero, np.zeros(1), np.zeros(0, np.int64), 0, float(np.log(p / (1 - p))))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 10) -> Forest:
    """Boost logistic loss on histogram splits.

    ``monotone`` has +1, -1 or 0 for each feature: a split that would go against it is not made, and
    the bounds that a constrained split sets hold for everything below it.
    """
    if len(y) == 0 or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    p = float(y.mean())
    base = float(np.log(p / (1 - p)))
    raw = np.full(len(y), base)
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots = []

    def add(feature=0, threshold=0.0, value=0.0) -> int:
        i = len(nodes["value"])
        for k, v in (("feature", feature), ("threshold", threshold), ("left", i), ("right", i), ("value", value)):
            nodes[k].append(v)
        return i

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, level: int) -> int:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, j]
                gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                gr, hr = total_g - gl, total_h - hl
                wl, wr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                gain = -(gl * wl + 0.5 * (hl + ridge) * wl**2) - (gr * wr + 0.5 * (hr + ridge) * wr**2) - total_g**2 / (total_h + ridge) / 2
                bad = (nl < least) | (len(rows) - nl < least) | ((wr - wl) * monotone[j] < 0)
                gain[bad] = -np.inf
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], j, k, wl[k], wr[k])
        if best[1] is None:
            return add(value=float(np.clip(-total_g / (total_h + ridge), low, high)) * rate)
        _, j, k, wl, wr = best
        i, mid, to_left = add(j, float(cuts[j][k])), (wl + wr) / 2, binned[rows, j] <= k
        spans = ((low, mid), (mid, high)) if monotone[j] > 0 else ((mid, high), (low, mid)) if monotone[j] < 0 else ((low, high), (low, high))
        nodes["left"][i] = grow(rows[to_left], g, h, *spans[0], level + 1)
        nodes["right"][i] = grow(rows[~to_left], g, h, *spans[1], level + 1)
        return i

    for _ in range(trees):
        q = 1 / (1 + np.exp(-raw))
        roots.append(grow(np.arange(len(y)), q - y, q * (1 - q), -6.0, 6.0, 0))
        tree = Forest(*(np.array(nodes[k]) for k in nodes), np.array(roots[-1:]), depth, 0.0)
        raw += tree.raw(x)
    return Forest(*(np.array(nodes[k]) for k in nodes), np.array(roots), depth, base)
