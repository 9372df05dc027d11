"""Gradient-boosted trees for small tables of ordinal features, in numpy."""

from __future__ import annotations

import numpy as np


def _cuts(values: np.ndarray, most: int = 63) -> np.ndarray:
    """Places to split at: all values but the largest, or as many quantiles."""
    at = np.unique(values)[:-1]
    return at if len(at) <= most else np.unique(np.quantile(values, np.linspace(0, 1, most + 2)[1:-1], method="lower"))


class BoostedTrees:
    """Binary classifier: logistic loss, trees grown depth-first on feature <= value splits."""

    def __init__(self, rounds: int = 60, depth: int = 5, rate: float = 0.3, ridge: float = 0.3, least: float = 1e-3):
        self.rounds, self.depth, self.rate, self.ridge, self.least = rounds, depth, rate, ridge, least
        self.base, self.trees, self.scale = 0.0, [], (1.0, 0.0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
        rate = np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        cuts = [_cuts(x[:, k]) for k in range(x.shape[1])]
        width = max((len(c) for c in cuts), default=0) + 1
        binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1) if len(y) else x.astype(int)
        # a cell of the flat histogram per feature and bin; cuts beyond a feature's own cannot win
        cells = binned + np.arange(len(cuts)) * width
        open_ = np.arange(width - 1)[None, :] < np.array([len(c) for c in cuts])[:, None]
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree: list[tuple] = []
            self._grow(tree, binned, cells, open_, cuts, p - y, p * (1 - p), np.arange(len(y)), self.depth, score)
            self.trees.append(tree)
        return self

    def _grow(self, tree, binned, cells, open_, cuts, g, h, rows, depth, score) -> int:
        at = len(tree)
        tree.append(None)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (self.least, -1, 0)
        if depth and len(rows) > 1 and open_.size:
            n, width = len(cuts), open_.shape[1] + 1
            flat = cells[rows].ravel()
            lg = np.cumsum(np.bincount(flat, np.repeat(g[rows], n), n * width).reshape(n, width), axis=1)[:, :-1]
            lh = np.cumsum(np.bincount(flat, np.repeat(h[rows], n), n * width).reshape(n, width), axis=1)[:, :-1]
            gain = lg**2 / (lh + self.ridge) + (total_g - lg) ** 2 / (total_h - lh + self.ridge) - total_g**2 / (total_h + self.ridge)
            gain = np.where(open_, gain, -np.inf)
            i = int(gain.argmax())
            if gain.flat[i] > best[0]:
                best = (float(gain.flat[i]), i // (width - 1), i % (width - 1))
        if best[1] < 0:
            value = -self.rate * total_g / (total_h + self.ridge)
            score[rows] += value
            tree[at] = (-1, float(value), 0, 0)
            return at
        _, k, i = best
        left = binned[rows, k] <= i
        a = self._grow(tree, binned, cells, open_, cuts, g, h, rows[left], depth - 1, score)
        b = self._grow(tree, binned, cells, open_, cuts, g, h, rows[~left], depth - 1, score)
        tree[at] = (k, float(cuts[k][i]), a, b)
        return at

    def raw(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float64)
        out = np.full(len(x), self.base)
        for tree in self.trees:
            stack = [(0, np.arange(len(x)))]
            while stack:
                n, rows = stack.pop()
                if not len(rows):
                    continue
                k, v, a, b = tree[n]
                if k < 0:
                    out[rows] += v
                else:
                    left = x[rows, k] <= v
                    stack += [(a, rows[left]), (b, rows[~left])]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 200) -> BoostedTrees:
        """Platt scaling on rows not used in fitting."""
        s, y = self.raw(x), np.asarray(y, np.float64)
        a, b = 1.0, 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(a * s + b)))
            a -= 0.05 * (((p - y) * s).mean() + 0.01 * (a - 1))
            b -= 0.05 * (p - y).mean()
        self.scale = (float(a), float(b))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-(a * self.raw(x) + b)))
