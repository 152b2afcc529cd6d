"""Gradient-boosted trees for binary labels, small enough to train on the driver and ship to tasks."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting of depth-limited regression trees over quantile splits."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, splits: int = 24) -> None:
        self.rounds, self.depth, self.rate, self.splits = rounds, depth, rate, splits
        self.trees: list[list[tuple[int, float, float]]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.base)
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.splits + 1)[:-1])) for c in x.T]
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, y - p, p * (1 - p), edges)
            self.trees.append(tree)
            score += self.rate * self._walk(tree, x)
        return self

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray]) -> list[tuple[int, float, float]]:
        """A complete binary tree in heap order; entries are (feature or -1, split, value)."""
        tree: list[tuple[int, float, float]] = []
        rows: list[np.ndarray] = [np.ones(len(g), dtype=bool)]
        for node in range(2 ** (self.depth + 1) - 1):
            at = rows[node]
            value = float(g[at].sum() / (h[at].sum() + 1.0)) if at.any() else 0.0
            best = (1e-6, -1, 0.0)
            if node < 2**self.depth - 1 and at.sum() > 8:
                whole = g[at].sum() ** 2 / (h[at].sum() + 1.0)
                for f, cuts in enumerate(edges):
                    bins = np.searchsorted(cuts, x[at, f], side="left")
                    gs, hs = np.cumsum(np.bincount(bins, g[at], len(cuts) + 1)), np.cumsum(np.bincount(bins, h[at], len(cuts) + 1))
                    gain = gs[:-1] ** 2 / (hs[:-1] + 1.0) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1.0) - whole
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, float(cuts[k]))
            _, f, cut = best
            tree.append((f, cut, value))
            if node < 2**self.depth - 1:
                low = at & (x[:, f] <= cut) if f >= 0 else at
                rows += [low, at & ~low]
        return tree

    def _walk(self, tree: list[tuple[int, float, float]], x: np.ndarray) -> np.ndarray:
        feature, cut, value = (np.array(c) for c in zip(*tree, strict=True))
        node = np.zeros(len(x), dtype=int)
        for _ in range(self.depth):
            f = feature[node]
            node = np.where(f < 0, node, 2 * node + 1 + (x[np.arange(len(x)), f] > cut[node]))
        return value[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for tree in self.trees:
            score += self.rate * self._walk(tree, x)
        return 1 / (1 + np.exp(-score))
