"""Gradient-boosted trees for a few classes: shallow trees over binned features, one tree a round for all classes."""

from __future__ import annotations

import numpy as np

BINS = 32


class BoostedTrees:
    """Softmax boosting. Every tree has the full depth; a leaf holds one value for each class."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.3, ridge: float = 2.0):
        self.rounds, self.depth, self.rate, self.ridge = rounds, depth, rate, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)]).astype(np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray, classes: int) -> BoostedTrees:
        """x: rows of features; y: their classes, from 0."""
        quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, f], quantiles, method="lower")) for f in range(x.shape[1])]
        codes, goal = self._binned(x), np.eye(classes)[y]
        share = goal.mean(axis=0)
        self.base = np.log(np.maximum(share, 1e-6))
        scores = np.tile(self.base, (len(y), 1))
        for _ in range(self.rounds):
            p = np.exp(scores - scores.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            tree, leaf = self._grow(codes, goal - p, p * (1 - p))
            self.trees.append(tree)
            scores += tree[2][leaf]
        return self

    def _grow(self, codes: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        n, width = codes.shape
        classes = gradient.shape[1]
        feature, cut = np.zeros(2**self.depth - 1, dtype=np.int64), np.full(2**self.depth - 1, BINS, dtype=np.int64)
        at = np.zeros(n, dtype=np.int64)
        columns = (np.arange(width) * BINS)[None, :] + codes
        for level in range(self.depth):
            nodes = 2**level
            cells = ((at * width * BINS)[:, None] + columns).ravel()
            histogram = lambda v: np.bincount(cells, np.repeat(v, width), nodes * width * BINS).reshape(nodes, width, BINS).cumsum(axis=2)  # noqa: E731, B023
            gain, h = 0.0, histogram(hessian.mean(axis=1))
            every_h = h[:, :, -1:]
            for k in range(classes):
                g = histogram(gradient[:, k])
                every_g = g[:, :, -1:]
                gain = gain + g**2 / (h + self.ridge) + (every_g - g) ** 2 / (every_h - h + self.ridge) - every_g**2 / (every_h + self.ridge)
            gain = gain.reshape(nodes, -1)
            best = gain.argmax(axis=1)
            first = nodes - 1
            feature[first : first + nodes] = best // BINS
            cut[first : first + nodes] = np.where(gain[np.arange(nodes), best] > 1e-9, best % BINS, BINS)
            at = 2 * at + (codes[np.arange(n), feature[first + at]] > cut[first + at])
        leaves = 2**self.depth
        value = np.column_stack([np.bincount(at, gradient[:, k], leaves) / (np.bincount(at, hessian[:, k], leaves) + self.ridge) for k in range(classes)])
        return (feature, cut, self.rate * value), at

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        codes, rows = self._binned(x), np.arange(len(x))
        scores = np.tile(self.base, (len(x), 1))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for level in range(self.depth):
                node = at + 2**level - 1
                at = 2 * at + (codes[rows, feature[node]] > cut[node])
            scores += value[at]
        scores -= scores.max(axis=1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))
