"""Gradient-boosted trees for a 0/1 label, on histograms of features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Full binary trees in breadth-first order: a row goes right at a node if its feature is above the bound."""

    feature: np.ndarray  # [trees, inner nodes]
    bound: np.ndarray  # [trees, inner nodes]
    leaf: np.ndarray  # [trees, leaves]
    base: float

    @property
    def depth(self) -> int:
        return int(np.log2(self.leaf.shape[1]))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1 of each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, bound, leaf in zip(self.feature, self.bound, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > bound[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 1.0, ridge: float = 1.0) -> Trees:
    """Boosts trees on logistic loss; splits lie on up to ``bins`` quantiles of each feature."""
    n, m = x.shape
    bounds = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
    binned = np.stack([np.searchsorted(b, x[:, j], "left") for j, b in enumerate(bounds)], axis=1)
    width = max(len(b) for b in bounds) + 1
    columns = np.arange(m) * width
    p = (y.sum() + 1) / (n + 2)
    model = Trees(np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth)), float(np.log(p / (1 - p))))
    margin = np.full(n, model.base)
    for t in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, np.maximum(q * (1 - q), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            count = 2**level
            key = ((node[:, None] * m * width) + columns + binned).ravel()
            size = count * m * width
            sums = [np.bincount(key, np.repeat(v, m), size).reshape(count, m, width).cumsum(axis=2) for v in (g, h)]
            total_g, total_h = sums[0][:, :1, -1:], sums[1][:, :1, -1:]
            left_g, left_h = sums[0], sums[1]
            right_g, right_h = total_g - left_g, total_h - left_h
            gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - total_g**2 / (total_h + ridge)
            gain[(left_h < least) | (right_h < least)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            f, b = best // width, best % width
            use = gain.reshape(count, -1)[np.arange(count), best] > 1e-9
            at = count - 1 + np.arange(count)
            model.feature[t, at] = f
            model.bound[t, at] = [bounds[j][k] if ok and k < len(bounds[j]) else np.inf for j, k, ok in zip(f, b, use, strict=True)]
            cut = np.where(use, b, width)
            node = 2 * node + (binned[np.arange(n), f[node]] > cut[node])
        leaf_g, leaf_h = np.bincount(node, g, 2**depth), np.bincount(node, h, 2**depth)
        model.leaf[t] = -rate * leaf_g / (leaf_h + ridge)
        margin += model.leaf[t][node]
    return model
