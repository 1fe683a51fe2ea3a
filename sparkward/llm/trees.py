"""Gradient-boosted trees in numpy: histogram splits, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosted:
    """Trees as arrays [tree, node]; node i's children are 2 i + 1 and 2 i + 2, leaves are at the last level."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row."""
        total = np.full(len(x), self.base)
        row = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[row, feature[node]] > threshold[node])
            total += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    monotone: np.ndarray | None = None,
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 48,
    l2: float = 1.0,
    least: int = 10,
) -> Boosted:
    """Fit to labels 0 and 1. monotone[f] is 1 or -1 where the score may only rise or fall with feature f."""
    n, width = x.shape
    signs = np.zeros(width, int) if monotone is None else monotone
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    value = np.zeros((trees, leaves))
    total = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, hessian = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        bounds = {0: (-np.inf, np.inf)}
        for i in range(inner):
            low, high = bounds[i]
            bounds[2 * i + 1] = bounds[2 * i + 2] = (low, high)
            own = np.flatnonzero(node == i)
            best = _split(binned[own], gradient[own], hessian[own], edges, signs, l2, least, low, high) if len(own) >= 2 * least else None
            if best is None:
                node[own] = 2 * i + 1
                continue
            f, cut, left, right = best
            feature[t, i], threshold[t, i] = f, edges[f][cut]
            node[own] = 2 * i + 1 + (binned[own, f] > cut)
            if signs[f]:
                middle = (left + right) / 2
                bounds[2 * i + 1] = (low, middle) if signs[f] > 0 else (middle, high)
                bounds[2 * i + 2] = (middle, high) if signs[f] > 0 else (low, middle)
        for leaf in range(leaves):
            own = node == inner + leaf
            if own.any():
                raw = gradient[own].sum() / (hessian[own].sum() + l2)
                value[t, leaf] = rate * float(np.clip(raw, *bounds[inner + leaf]))
            else:
                value[t, leaf] = rate * float(np.clip(0.0, *bounds[inner + leaf]))
        total += value[t][node - inner]
    return Boosted(base, feature, threshold, value, depth)


def _split(binned, gradient, hessian, edges, signs, l2, least, low, high):
    """(feature, bin, value left, value right) of the best allowed split, or None."""
    best, gain = None, 1e-6
    whole = gradient.sum() ** 2 / (hessian.sum() + l2)
    for f, edge in enumerate(edges):
        if not len(edge):
            continue
        size = len(edge) + 1
        g, h, c = (np.bincount(binned[:, f], w, size).cumsum() for w in (gradient, hessian, None))
        gl, hl, cl = g[:-1], h[:-1], c[:-1]
        gr, hr = g[-1] - gl, h[-1] - hl
        left, right = np.clip(gl / (hl + l2), low, high), np.clip(gr / (hr + l2), low, high)
        won = 2 * gl * left - (hl + l2) * left**2 + 2 * gr * right - (hr + l2) * right**2 - whole
        won[(cl < least) | (c[-1] - cl < least) | (signs[f] * (right - left) < 0)] = -np.inf
        at = int(np.argmax(won))
        if won[at] > gain:
            best, gain = (f, at, float(left[at]), float(right[at])), won[at]
    return best
