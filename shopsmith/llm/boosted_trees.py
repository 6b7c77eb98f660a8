"""Histogram gradient-boosted trees for two classes, flattened into arrays.

Every tree is complete to a fixed depth and stored by level: the children of node i are
2 i + 1 and 2 i + 2, so scoring walks all rows down all trees with plain array look-ups.
"""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """``feature``, ``threshold`` (trees x inner nodes), ``value`` (trees x leaves), ``base``."""

    def __init__(self, feature, threshold, value, base):
        self.feature, self.threshold, self.value, self.base = feature, threshold, value, base

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of ``x`` (rows x features)."""
        x = np.asarray(x, float).reshape(len(x), -1)
        raw, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            raw += v[node - inner]
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15,
        bins: int = 64, least_rows: float = 10, ridge: float = 1.0) -> BoostedTrees:
    """Newton boosting of the logistic loss on binned features.  Without rows, or with one
    class only, the model is that class's smoothed share."""
    y = np.asarray(y, float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    inner, none = 2 ** depth - 1, (0, 2 ** depth)
    if not len(y) or y.min() == y.max():
        return BoostedTrees(np.empty((0, inner), int), np.empty((0, inner)), np.empty(none), base)
    x = np.asarray(x, float)
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    raw, out_f, out_t, out_v = np.full(n, base), [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            best = np.full(width, 1e-6)
            split = np.zeros(width, int)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                key = (node - first) * bins + binned[:, j]
                hist = [np.bincount(key, w, width * bins).reshape(width, bins).cumsum(axis=1) for w in (g, h, None)]
                (gl, hl, nl), (gt, ht, nt) = hist, [a[:, -1:] for a in hist]
                gain = gl ** 2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt ** 2 / (ht + ridge)
                gain[(nl < least_rows) | (nt - nl < least_rows)] = -np.inf
                gain[:, len(c):] = -np.inf
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better], split[better] = top[better], at[better]
                feature[first:first + width][better] = j
                threshold[first:first + width][better] = c[at[better]]
            f = feature[node]
            node = 2 * node + 1 + (x[np.arange(n), f] > threshold[node])
        leaf = node - inner
        size = 2 ** depth
        value = rate * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + ridge)
        raw += value[leaf]
        out_f.append(feature)
        out_t.append(threshold)
        out_v.append(value)
    return BoostedTrees(np.array(out_f), np.array(out_t), np.array(out_v), base)
