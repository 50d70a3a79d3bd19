"""Small learners in numpy for bounded training samples: gradient-boosted trees and logistic regression."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Gradient boosting of shallow regression trees on the logistic loss, with features cut into quantile bins."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 20):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[list[tuple[int, float]]] = []
        self.leaves: list[np.ndarray] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        if not len(y):
            return self
        # Quantiles of each class: those of all rows would not tell the few of a rare class apart.
        at, classes = np.linspace(0, 1, self.bins + 1)[1:-1], [y == value for value in np.unique(y)]
        edges = [np.unique(np.concatenate([np.quantile(column[rows], at) for rows in classes])) for column in x.T]
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        binned = [np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T)]
        # Rows of the same bins and class are one row that weighs as many: no split can tell them apart.
        same = np.unique(y, return_inverse=True)[1]
        for column, e in zip(binned, edges):
            same = np.unique(same * (len(e) + 1) + column, return_inverse=True)[1]
        _, first, weight = np.unique(same, return_index=True, return_counts=True)
        x, y, binned = x[first], y[first], np.stack([column[first] for column in binned], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            gradient, curve = weight * (y - p), weight * (p * (1 - p) + 1e-6)
            node = np.zeros(len(y), int)
            tree: list[tuple[int, float]] = []
            for level in range(self.depth):
                splits = [self._split(binned, edges, gradient, curve, weight, np.flatnonzero(node == n)) for n in range(2**level)]
                tree += splits
                feature = np.array([f for f, _ in splits])[node]
                cut = np.array([c for _, c in splits])[node]
                node = 2 * node + (x[np.arange(len(y)), feature] > cut)
            count = 2**self.depth
            leaf = np.bincount(node, gradient, count) / (np.bincount(node, curve, count) + 1.0)
            self.trees.append(tree)
            self.leaves.append(leaf * self.rate)
            score = score + self.leaves[-1][node]
        return self

    def _split(self, binned, edges, gradient, curve, weight, rows) -> tuple[int, float]:
        best = (0.0, 0, np.inf)
        g, c, w = gradient[rows], curve[rows], weight[rows]
        for f in range(binned.shape[1] if w.sum() >= 2 * self.least else 0):
            n = len(edges[f]) + 1
            if n < 2:
                continue
            left_g, left_c = np.cumsum(np.bincount(binned[rows, f], g, n))[:-1], np.cumsum(np.bincount(binned[rows, f], c, n))[:-1]
            size = np.cumsum(np.bincount(binned[rows, f], w, n))[:-1]
            gain = left_g**2 / (left_c + 1) + (g.sum() - left_g) ** 2 / (c.sum() - left_c + 1) - g.sum() ** 2 / (c.sum() + 1)
            gain = np.where((size >= self.least) & (w.sum() - size >= self.least), gain, 0)
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (float(gain[at]), f, float(edges[f][at]))
        return best[1], best[2]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 of each row."""
        score, columns = np.full(len(x), self.base), np.ascontiguousarray(x.T)
        for tree, leaf in zip(self.trees, self.leaves):
            # The splits of a level lie side by side; from the last level up, each row takes the half that its value names.
            held = list(leaf)
            for level in range(self.depth - 1, -1, -1):
                splits = tree[2**level - 1 : 2 ** (level + 1) - 1]
                held = [np.where(columns[f] > cut, held[2 * n + 1], held[2 * n]) for n, (f, cut) in enumerate(splits)]
            score += held[0]
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> tuple[np.ndarray, float]:
    """(weights, intercept) of a ridge logistic regression, by Newton steps on standardised features."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        move = np.linalg.solve(h, z.T @ (y - p) - penalty * w)
        w += move
        if np.abs(move).max() < 1e-6:
            break
    weights = w[:-1] / spread
    return weights, float(w[-1] - weights @ mean)
