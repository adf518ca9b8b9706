"""Gradient-boosted trees for small integer features, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Log-loss boosting of depth-limited trees over features from 0 to 31."""

    BINS = 32

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.3, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.l2 = rounds, depth, rate, l2
        self.bias, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x = np.clip(x, 0, self.BINS - 1).astype(np.int64)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        total = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-total))
            tree, leaf = self._grow(x, y - p, p * (1 - p))
            self.trees.append(tree)
            total += np.array([tree[i][3] for i in range(len(tree))])[leaf]
        return self

    def _grow(self, x, g, h):
        """Nodes (feature, bin, left child, value); the leaf of each row."""
        nodes: list[list] = [[-1, 0, 0, 0.0]]
        at = np.zeros(len(g), dtype=np.int64)
        level = [0]
        for _ in range(self.depth):
            following = []
            for node in level:
                rows = np.flatnonzero(at == node)
                if len(rows) < 8:
                    continue
                gs, hs = g[rows].sum(), h[rows].sum()
                best = (1e-6, -1, 0)
                for f in range(x.shape[1]):
                    gl = np.cumsum(np.bincount(x[rows, f], g[rows], self.BINS))[:-1]
                    hl = np.cumsum(np.bincount(x[rows, f], h[rows], self.BINS))[:-1]
                    gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
                    b = int(np.argmax(gain))
                    if gain[b] > best[0] + 1e-9:
                        best = (gain[b], f, b)
                if best[1] >= 0:
                    child = len(nodes)
                    nodes[node][:3] = [best[1], best[2], child]
                    nodes += [[-1, 0, 0, 0.0], [-1, 0, 0, 0.0]]
                    at[rows] = child + (x[rows, best[1]] > best[2])
                    following += [child, child + 1]
            level = following
        gs, hs = np.bincount(at, g, len(nodes)), np.bincount(at, h, len(nodes))
        for i, node in enumerate(nodes):
            node[3] = float(self.rate * gs[i] / (hs[i] + self.l2))
        return [tuple(n) for n in nodes], at

    def probability(self, row: tuple[int, ...]) -> float:
        total = self.bias
        for tree in self.trees:
            f, b, child, value = tree[0]
            while f >= 0:
                f, b, child, value = tree[child + (min(row[f], self.BINS - 1) > b)]
            total += value
        return float(1 / (1 + np.exp(-total)))
