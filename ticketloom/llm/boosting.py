"""Gradient-boosted trees for a binary label, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting of trees of fixed depth on features cut into bins. Trees are complete: a node without a gain
    splits nothing off. A threshold is calibrated on held-out rows."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 24):
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.base, self.cuts, self.nodes, self.leaves, self.threshold = 0.0, [], [], [], 0.5

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1).astype(np.int16)

    def fit(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, precision: float = 0.97) -> Boosted:
        """The held rows give the threshold: the middle of those at which `precision` is met and no more positive rows are lost."""
        used = ~held
        xs, ys = x[used], y[used].astype(float)
        self.cuts = [np.unique(np.quantile(xs[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._binned(xs)
        mean = np.clip(ys.mean() if len(ys) else 0.5, 0.01, 0.99)
        self.base = float(np.log(mean / (1 - mean)))
        f = np.full(len(xs), self.base)
        width = self.bins + 1
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = ys - p, p * (1 - p) + 1e-6
            at = np.zeros(len(xs), np.int64)
            splits: list[tuple[int, int]] = []
            for level in range(self.depth):
                nodes = 2**level
                best = np.full(nodes, 1e-3)
                choice = [(0, width)] * nodes
                for j in range(x.shape[1]):
                    key = at * width + b[:, j]
                    gs = np.bincount(key, g, nodes * width).reshape(nodes, width).cumsum(1)
                    hs = np.bincount(key, h, nodes * width).reshape(nodes, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    k = gain[:, :-1].argmax(1)
                    top = gain[np.arange(nodes), k]
                    for n in np.flatnonzero(top > best):
                        best[n], choice[n] = top[n], (j, int(k[n]))
                splits += choice
                feature = np.array([c[0] for c in choice])[at]
                cut = np.array([c[1] for c in choice])[at]
                at = 2 * at + (b[np.arange(len(b)), feature] > cut)
            size = 2**self.depth
            leaf = self.rate * np.bincount(at, g, size) / (np.bincount(at, h, size) + 1)
            f += leaf[at]
            self.nodes.append(np.array(splits))
            self.leaves.append(leaf)
        self.threshold = self._calibrated(self.predict(x[held]), y[held], precision)
        return self

    @staticmethod
    def _calibrated(p: np.ndarray, y: np.ndarray, precision: float) -> float:
        if not len(p) or not y.any():
            return 0.5
        order = np.argsort(-p, kind="stable")
        hit = np.cumsum(y[order]) / np.arange(1, len(p) + 1)
        good = np.flatnonzero(hit >= precision)
        found = good[y[order][good] == 1]
        if not len(found):
            return 1.0
        scores = p[order]
        upper, last = scores[found[-1]], max(good[-1], found[-1] + 1)
        return float((upper + (scores[last] if last < len(p) else 0.0)) / 2)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        b = self._binned(x)
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for splits, leaf in zip(self.nodes, self.leaves):
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                s = splits[2**level - 1 + at]
                at = 2 * at + (b[rows, s[:, 0]] > s[:, 1])
            f += leaf[at]
        return 1 / (1 + np.exp(-f))
