"""Gradient-boosted trees for a binary label, with histograms in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class BoostedTrees:
    """Complete trees of one depth: node j has children 2j+1 and 2j+2; leaves follow the inner nodes."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def logit(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.bin(x), np.arange(len(x))
        z = np.full(len(x), self.start)
        for f, c, v in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[rows, f[at]] > c[at])
            z += v[at - len(f)]
        return z


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 24, rate: float = 0.25, ridge: float = 2.0) -> BoostedTrees:
    """Newton boosting on the weighted logistic loss, labels from 0 to 1; splits maximise the usual gain."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    inner, n, m = 2**depth - 1, len(x), x.shape[1]
    mean = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3))
    model = BoostedTrees(edges, np.zeros((trees, inner), np.int64), np.full((trees, inner), bins, np.int64), np.zeros((trees, 2**depth)), float(np.log(mean / (1 - mean))), depth)
    b = model.bin(x).astype(np.int64)
    z = np.full(n, model.start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = weight * (p - y), weight * p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            place = at - first
            best = np.full(width, 1e-6)
            for j in range(m):
                k = place * bins + b[:, j]
                gl = np.bincount(k, g, width * bins).reshape(width, bins).cumsum(axis=1)
                hl = np.bincount(k, h, width * bins).reshape(width, bins).cumsum(axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                c = gain[:, :-1].argmax(axis=1)
                top = gain[np.arange(width), c]
                better = top > best
                best[better] = top[better]
                model.feature[t, first : first + width][better] = j
                model.cut[t, first : first + width][better] = c[better]
            at = 2 * at + 1 + (b[np.arange(n), model.feature[t, at]] > model.cut[t, at])
        leaf = at - inner
        model.value[t] = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        z += model.value[t, leaf]
    return model
