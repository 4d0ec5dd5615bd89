"""Gradient-boosted regression trees for a yes/no target, in numpy: trained on a small table, applied to batches of rows."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Complete trees of one depth: feature and threshold by inner node, a value by leaf."""

    def __init__(self, depth: int, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, start: float) -> None:
        self.depth, self.feature, self.threshold, self.value, self.start = depth, feature, threshold, value, start

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 4, rate: float = 0.3, bins: int = 24, ridge: float = 1.0) -> BoostedTrees:
        """Newton steps on the logistic loss; candidate thresholds are quantiles of each feature."""
        n, m = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
        code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)  # code <= k means x <= cuts[k]
        inner = 2**depth - 1
        feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 2**depth))
        p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        start = float(np.log(p0 / (1 - p0)))
        score = np.full(n, start)
        for t in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            for at in range(inner):
                rows = np.flatnonzero(node == at)
                best = (1e-6, 0, np.inf)
                if len(rows) >= 8:
                    gs, hs = g[rows].sum(), h[rows].sum()
                    for j in range(m):
                        if not len(cuts[j]):
                            continue
                        k = len(cuts[j]) + 1
                        gl = np.bincount(code[rows, j], g[rows], k).cumsum()[:-1]
                        hl = np.bincount(code[rows, j], h[rows], k).cumsum()[:-1]
                        gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                        i = int(gain.argmax())
                        if gain[i] > best[0]:
                            best = (float(gain[i]), j, float(cuts[j][i]))
                feature[t, at], threshold[t, at] = best[1], best[2]
                node[rows] = 2 * at + 1 + (x[rows, best[1]] > best[2])
            leaf = node - inner
            gl, hl = np.bincount(leaf, g, 2**depth), np.bincount(leaf, h, 2**depth)
            value[t] = rate * gl / (hl + ridge)
            score += value[t][leaf]
        return cls(depth, feature, threshold, value, start)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        score, inner = np.full(len(x), self.start), 2**self.depth - 1
        columns = np.ascontiguousarray(x.T)
        n = len(x)
        flat, rows = columns.reshape(-1), np.arange(n)
        for t in range(len(self.value)):
            feature, threshold = self.feature[t] * n, self.threshold[t].astype(x.dtype)
            node = (columns[self.feature[t][0]] > threshold[0]) + 1
            for _ in range(self.depth - 1):
                node = 2 * node + 1 + (flat[feature[node] + rows] > threshold[node])
            score += self.value[t][node - inner]
        return score
