"""Gradient-boosted regression trees on small tables, by histograms in numpy; trained on the driver on bounded samples."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Squared-error boosting of trees of ``depth`` levels; every level splits all nodes at once on quantile bins.

    Each tree sees a seeded half of the features, so that several features that tell the same share the work, and a row
    that is odd in one of them is not lost.
    """

    def __init__(self, trees: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 48, least: int = 8) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, width = x.shape
        self.base = float(y.mean()) if n else 0.0
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) if n else np.zeros(0) for f in range(width)]
        code = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], axis=1) if n else np.zeros((0, width), int)
        value = np.full(n, self.base)
        draw = np.random.default_rng(7)
        for _ in range(self.trees if n >= 2 * self.least else 0):
            rest = y - value
            shut = draw.permutation(width)[max(1, -(-width // 2)) :]
            node = np.zeros(n, dtype=np.int64)
            features, limits = [], []
            for level in range(self.depth):
                nodes = 1 << level
                count = np.zeros((width, nodes, self.bins + 1))
                total = np.zeros((width, nodes, self.bins + 1))
                for f in range(width):
                    key = node * (self.bins + 1) + code[:, f]
                    count[f] = np.bincount(key, minlength=nodes * (self.bins + 1)).reshape(nodes, -1)
                    total[f] = np.bincount(key, rest, minlength=nodes * (self.bins + 1)).reshape(nodes, -1)
                left_n, left_s = count.cumsum(axis=2), total.cumsum(axis=2)
                all_n, all_s = left_n[:, :, -1:], left_s[:, :, -1:]
                right_n, right_s = all_n - left_n, all_s - left_s
                gain = left_s**2 / np.maximum(left_n, 1) + right_s**2 / np.maximum(right_n, 1) - all_s**2 / np.maximum(all_n, 1)
                gain[(left_n < self.least) | (right_n < self.least)] = -1
                gain[shut] = -1
                best = gain.transpose(1, 0, 2).reshape(nodes, -1).argmax(axis=1)
                feature, limit = np.divmod(best, self.bins + 1)
                none = gain[feature, np.arange(nodes), limit] <= 1e-12
                limit = np.where(none, self.bins + 1, limit)  # everything goes left
                features.append(feature)
                limits.append(limit)
                node = 2 * node + (code[np.arange(n), feature[node]] > limit[node])
            leaves = 1 << self.depth
            leaf = self.rate * np.bincount(node, rest, minlength=leaves) / (np.bincount(node, minlength=leaves) + 1.0)
            value = value + leaf[node]
            self.model.append((np.concatenate(features), np.concatenate(limits), leaf))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        code = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], axis=1) if n else np.zeros((0, len(self.cuts)), int)
        value = np.full(n, self.base)
        rows = np.arange(n)
        for feature, limit, leaf in self.model:
            node = np.zeros(n, dtype=np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (code[rows, feature[at]] > limit[at])
            value += leaf[node]
        return value


class Isotonic:
    """Least-squares non-decreasing map of predictions to labels (pool adjacent violators), linear between knots."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        order = np.argsort(x, kind="stable")
        blocks: list[list[float]] = []  # mean of y, weight, mean of x
        for a, b in zip(x[order], y[order], strict=True):
            blocks.append([float(b), 1.0, float(a)])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                m, w, c = blocks.pop()
                p = blocks[-1]
                blocks[-1] = [(p[0] * p[1] + m * w) / (p[1] + w), p[1] + w, (p[2] * p[1] + c * w) / (p[1] + w)]
        self.x, self.y = np.array([b[2] for b in blocks]), np.array([b[0] for b in blocks])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y) if len(self.x) else x
