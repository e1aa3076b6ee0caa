"""Gradient-boosted trees for two classes over dense features, and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Trees of one depth in arrays: [tree, node] for inner nodes, [tree, leaf] for values."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.value.shape[1]))
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - (2**depth - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, l2: float = 2.0, least: float = 1.0) -> Trees:
    """Newton boosting on the logistic loss; split points are quantiles of each feature."""
    n, d = x.shape
    if n == 0:
        return Trees(np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)), 0.0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    for j in range(d):  # a rare feature is mostly one value; half way to the next value must be a split point too
        values = np.unique(x[:, j])
        if len(values) > 1:
            cuts[j] = np.unique(np.append(cuts[j], (values[0] + values[1]) / 2))
    width = max(len(c) for c in cuts) + 1
    code = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(d)], axis=1)
    flat = code + np.arange(d) * width
    p0 = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    inner, leaves = 2**depth - 1, 2**depth
    feature, cut, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first = 2**level - 1
            for k in range(first, 2 * first + 1):
                own = node == k
                if not own.any():
                    continue
                idx = flat[own].ravel()
                gs = np.bincount(idx, np.repeat(g[own], d), d * width).reshape(d, width).cumsum(axis=1)
                hs = np.bincount(idx, np.repeat(h[own], d), d * width).reshape(d, width).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(hs < least) | (ht - hs < least)] = -1
                j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[j, b] > 1e-6 and b < len(cuts[j]):
                    feature[t, k], cut[t, k] = j, cuts[j][b]
            rows = np.arange(n)
            node = 2 * node + 1 + (x[rows, feature[t, node]] > cut[t, node])
        leaf = node - inner
        value[t] = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        margin += value[t, leaf]
    return Trees(feature, cut, value, base)


@dataclass
class Isotonic:
    at: np.ndarray
    p: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.at, self.p)


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; probabilities between the blocks' means are interpolated.

    Each block is shrunk by one pseudo-observation of the base rate, so none is 0 or 1 outright.
    """
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, count, sum of margins
    for m, v in zip(margin[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(m)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, c, a = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + c, blocks[-1][2] + a]
    rate = float(y.mean())
    return Isotonic(np.array([a / c for _, c, a in blocks]), np.array([(s + rate) / (c + 1) for s, c, _ in blocks]))
