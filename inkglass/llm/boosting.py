"""Gradient boosting of small regression trees for a yes or no, on arrays."""

from __future__ import annotations

import numpy as np


class Booster:
    """Trees of depth 3 over quantile bins; fitted on the driver on a bounded sample."""

    def __init__(self, rounds: int = 40, rate: float = 0.3, depth: int = 3, bins: int = 24):
        self.rounds, self.rate, self.depth, self.bins = rounds, rate, depth, bins
        self.trees: list[list[tuple[int, float, float]]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Booster:
        x, y = np.asarray(x, float), np.asarray(y, float)
        p = min(max(y.mean(), 0.01), 0.99) if len(y) else 0.5
        self.base = float(np.log(p / (1 - p)))
        if len(y) < 2 or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            grad, hess = y - prob, prob * (1 - prob)
            node, tree = np.zeros(len(y), int), {}
            for at in range(2**self.depth - 1):
                rows = node == at
                best = self._split(x[rows], grad[rows], hess[rows], cuts)
                tree[at] = best
                if best is None:
                    continue
                left = rows & (x[:, best[0]] <= best[1])
                node[left] = 2 * at + 1
                node[rows & ~left] = 2 * at + 2
            leaf = {n: self.rate * grad[node == n].sum() / (hess[node == n].sum() + 1.0) for n in np.unique(node)}
            self.trees.append((tree, leaf))
            score += np.array([leaf[n] for n in node])
        return self

    @staticmethod
    def _split(x, grad, hess, cuts):
        g, h = grad.sum(), hess.sum()
        best, gain = None, 1e-3
        for k, points in enumerate(cuts):
            for c in points:
                left = x[:, k] <= c
                gl, hl = grad[left].sum(), hess[left].sum()
                if hl < 0.5 or h - hl < 0.5:
                    continue
                now = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if now > gain:
                    best, gain = (k, float(c)), now
        return best

    def probability(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float).reshape(len(x), -1)
        score = np.full(len(x), self.base)
        for tree, leaf in self.trees:
            node = np.zeros(len(x), int)
            for at in range(2**self.depth - 1):
                if tree[at] is not None:
                    rows = node == at
                    node[rows] = np.where(x[rows, tree[at][0]] <= tree[at][1], 2 * at + 1, 2 * at + 2)
            score += np.array([leaf.get(n, 0.0) for n in node]) if len(x) else 0
        return 1 / (1 + np.exp(-score))
