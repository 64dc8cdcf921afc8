"""Gradient-boosted trees in numpy: small, for statistics of documents; and sigmoid calibration of their margins."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _sigmoid(m: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -m))


@dataclass
class Boosted:
    """Binary logistic boosting over quantile bins.  Trees are complete, of ``depth`` levels, stored as arrays."""

    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    ridge: float = 1.0
    edges: list[np.ndarray] = field(default_factory=list)
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, m = x.shape
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(m)]
        codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], 1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(n, self.base)
        self.nodes = []
        for _ in range(self.trees):
            p = _sigmoid(margin)
            g, h = y - p, np.maximum(p * (1 - p), 1e-9)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, self.bins, np.int64)
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                local = at - first
                best = np.zeros(width)
                for f in range(m):
                    slot = local * self.bins + codes[:, f]
                    gs = np.bincount(slot, g, width * self.bins).reshape(width, self.bins).cumsum(1)
                    hs = np.bincount(slot, h, width * self.bins).reshape(width, self.bins).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[:, -1] = 0
                    gain[(hs < 1) | (ht - hs < 1)] = 0
                    k = gain.argmax(1)
                    value = gain[np.arange(width), k]
                    better = value > best + 1e-9
                    feature[first : first + width][better], cut[first : first + width][better] = f, k[better]
                    best[better] = value[better]
                at = 2 * at + 1 + (codes[np.arange(n), feature[at]] > cut[at])
            leaf = at - (2**self.depth - 1)
            value = np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.ridge)
            self.nodes.append((feature, cut, self.rate * value))
            margin += self.rate * value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), np.int64)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (codes[rows, feature[at]] > cut[at])
            out += value[at - (2**self.depth - 1)]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 200) -> Boosted:
        """Slope and offset of the margin by Newton's method on Platt's smoothed targets."""
        z = self.margin(x)
        pos, neg = y.sum(), len(y) - y.sum()
        target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
        scale = max(float(z.std()), 1e-9)
        u = z / scale

        def loss(a: float, b: float) -> float:
            m = a * u + b
            return float(np.sum(np.logaddexp(0, m) - target * m) + 0.005 * (a * a + b * b))

        a, b = 1.0, 0.0
        for _ in range(steps):
            p = _sigmoid(a * u + b)
            w = p * (1 - p)
            g = np.array([np.sum((target - p) * u) - 0.01 * a, np.sum(target - p) - 0.01 * b])
            hess = np.array([[np.sum(w * u * u) + 0.01, np.sum(w * u)], [np.sum(w * u), np.sum(w) + 0.01]])
            d, size = np.linalg.solve(hess, g), 1.0
            while size > 1e-6 and loss(a + size * d[0], b + size * d[1]) > loss(a, b):
                size /= 2  # Newton's step overshoots where the kinds are apart
            a, b = a + size * d[0], b + size * d[1]
            if np.abs(size * d).max() < 1e-8:
                break
        a /= scale
        self.slope, self.offset = float(max(a, 1e-3)), float(b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.margin(x) + self.offset)
