"""Gradient-boosted trees over binned dense features, and isotonic calibration; numpy only, for bounded samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosted:
    """Trees as arrays over a complete binary tree of `depth` levels; rows go right where feature > cut."""

    depth: int
    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 4.0, ridge: float = 1.0) -> Boosted:
    """Second-order boosting of the logistic loss; a node splits where the gain is largest and both sides keep at
    least `least` of hessian weight, less for small samples."""
    n, width = x.shape
    least = min(least, max(1.0, 0.004 * n * float(y.mean() * (1 - y.mean())))) if n else least
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.array([]) for j in range(width)]
    # rare non-zero values fall beyond the quantiles: they get cuts of their own
    for j in range(width):
        tail = x[:, j][x[:, j] > (cuts[j][-1] if len(cuts[j]) else -np.inf)]
        if len(tail):
            cuts[j] = np.unique(np.concatenate([cuts[j], [tail.min() - 1e-9 * abs(tail.min()) - 1e-12], np.quantile(tail, np.linspace(0, 1, 9)[1:-1])]))
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], axis=1)
    share = float(np.clip(y.mean() if n else 0.0, 1e-4, 1 - 1e-4))
    base = float(np.log(share / (1 - share)))
    score, inner, leaves = np.full(n, base), 2**depth - 1, 2**depth
    feature, cut, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess, node = y - p, p * (1 - p), np.zeros(n, np.int64)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                own = np.flatnonzero(node == k)
                g, h, best = grad[own].sum(), hess[own].sum(), (1e-6, None)
                if h < 2 * least:
                    continue
                for j in range(width):
                    size = len(cuts[j]) + 1
                    if size < 2:
                        continue
                    gl = np.cumsum(np.bincount(binned[own, j], grad[own], size))[:-1]
                    hl = np.cumsum(np.bincount(binned[own, j], hess[own], size))[:-1]
                    gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                    gain[(hl < least) | (h - hl < least)] = 0
                    if gain[at := int(gain.argmax())] > best[0]:
                        best = (float(gain[at]), (j, at))
                if best[1]:
                    feature[t, k], cut[t, k] = best[1][0], cuts[best[1][0]][best[1][1]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t][node]] > cut[t][node])
        leaf = node - inner
        value[t] = rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + ridge)
        score += value[t][leaf]
    return Boosted(depth, base, feature, cut, value)


@dataclass(frozen=True)
class Isotonic:
    """A rising function through the means of pooled blocks, straight lines between them."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, self.at, self.value), 0.0, 1.0)


def isotonic(raw: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pools neighbours that fall; each block is shrunk by half a row of each class, so no score is 0 or 1 for certain."""
    blocks: list[list[float]] = []
    for i in np.argsort(raw, kind="stable"):
        blocks.append([float(y[i]), 1.0, float(raw[i])])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, r = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + r]
    if not blocks:
        return Isotonic(np.array([0.0]), np.array([0.0]))
    value = np.maximum.accumulate([(s + 0.5) / (n + 1.0) for s, n, _ in blocks])
    return Isotonic(np.array([r / n for _, n, r in blocks]), value)
