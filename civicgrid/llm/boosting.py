"""Gradient-boosted decision trees for two classes, in numpy: quantile bins, logistic loss, second-order leaves."""

from __future__ import annotations

import numpy as np


class Trees:
    """``rounds`` trees of fixed depth over binned features. A tree is an implicit heap of (feature, bin) tests."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.edges: list[np.ndarray] = []
        self.tests: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Trees:
        w = np.ones(len(y)) if weight is None else weight
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins)[1:-1])) for f in range(x.shape[1])]
        binned = self._bin(x)
        share = np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(share / (1 - share)))
        z = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            tree, leaf = self._grow(binned, w * (p - y), w * p * (1 - p))
            self.tests.append(tree)
            z += tree[2][leaf]
        return self

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray):
        inner, wide = 2 ** self.depth - 1, self.bins + 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, self.bins)
        at = np.zeros(len(g), np.int64)
        for level in range(self.depth):
            base, n = 2 ** level - 1, 2 ** level
            best = np.full(n, 1e-6)
            for f in range(binned.shape[1]):
                slot = (at - base) * wide + binned[:, f]
                left_g = np.bincount(slot, g, n * wide).reshape(n, wide).cumsum(axis=1)
                left_h = np.bincount(slot, h, n * wide).reshape(n, wide).cumsum(axis=1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                gain = (left_g ** 2 / (left_h + self.ridge) + (all_g - left_g) ** 2 / (all_h - left_h + self.ridge)
                        - all_g ** 2 / (all_h + self.ridge))
                at_bin = gain.argmax(axis=1)
                better = gain[np.arange(n), at_bin] > best
                rows = np.flatnonzero(better)
                best[rows] = gain[rows, at_bin[rows]]
                feature[base + rows], cut[base + rows] = f, at_bin[rows]
            at = 2 * at + 1 + (binned[np.arange(len(at)), feature[at]] > cut[at])
        leaf = at - inner
        value = -self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.ridge)
        return (feature, cut, value), leaf

    def decide(self, x: np.ndarray) -> np.ndarray:
        """Log-odds."""
        binned, rows = self._bin(x), np.arange(len(x))
        z = np.full(len(x), self.base)
        for feature, cut, value in self.tests:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (binned[rows, feature[at]] > cut[at])
            z += value[at - len(feature)]
        return z
