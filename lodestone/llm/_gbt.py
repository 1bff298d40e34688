"""Histogram gradient-boosted trees for two classes; trained trees are flat arrays that numpy walks for many rows at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Complete binary trees of one depth: node k's children are 2k+1 and 2k+2. A row goes right where its value is
    larger than the threshold. A missing split has an infinite threshold: all rows go left."""

    feature: np.ndarray  # trees x (2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2**depth
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of n x features."""
        out = np.full(len(x), self.base)
        for low in range(0, len(x), 65_536):
            part = x[low : low + 65_536]
            rows = np.arange(len(part)) * x.shape[1]
            values = np.ascontiguousarray(part, np.float64).reshape(-1)
            total = out[low : low + 65_536]
            for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
                at = np.zeros(len(part), np.int64)
                for _ in range(self.depth):
                    at = 2 * at + 1 + (values[rows + feature[at]] > threshold[at])
                total += leaf[at - (2**self.depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: float = 5.0, penalty: float = 1.0) -> Forest:
    """Gradients of the logistic loss are summed in histograms of quantile bins; each level of a tree is split at once."""
    n, m = x.shape
    y = y.astype(np.float64)
    share = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    forest = Forest(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), base, depth)
    if n == 0 or y.min() == y.max():
        return Forest(forest.feature[:0], forest.threshold[:0], forest.leaf[:0], base if n else 0.0, depth)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], 1)  # bin k: value <= edge k
    raw = np.full(n, base)
    cells = binned + np.arange(m) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            nodes = 2**level
            where = (at[:, None] * (m * bins) + cells).reshape(-1)
            gs, hs, ns = (np.bincount(where, np.repeat(w, m), nodes * m * bins).reshape(nodes, m, bins) for w in (g, h, np.ones(n)))
            gl, hl, nl = gs.cumsum(2), hs.cumsum(2), ns.cumsum(2)
            gt, ht, nt = gl[:, :, -1:], hl[:, :, -1:], nl[:, :, -1:]
            gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
            gain[(nl < least) | (nt - nl < least)] = -1
            gain = gain.reshape(nodes, -1)
            best = gain.argmax(1)
            split_bin = np.full(nodes, bins)
            feature = np.zeros(nodes, np.int64)
            for k in range(nodes):
                j, b = divmod(int(best[k]), bins)
                if gain[k, best[k]] > 1e-9 and b < len(edges[j]):
                    feature[k], split_bin[k] = j, b
                    forest.feature[t, nodes - 1 + k], forest.threshold[t, nodes - 1 + k] = j, edges[j][b]
            at = 2 * at + (binned[np.arange(n), feature[at]] > split_bin[at])
        gs, hs = np.bincount(at, g, leaves), np.bincount(at, h, leaves)
        forest.leaf[t] = -rate * gs / (hs + penalty)
        raw += forest.leaf[t][at]
    return forest
