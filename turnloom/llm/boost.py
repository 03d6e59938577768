"""Gradient-boosted trees for two classes, on binned features, and calibration of their scores."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class BoostedTrees:
    """Logistic boosting of trees of fixed depth; all nodes of a level split at the same feature and bin, so a leaf is a few comparisons.

    Without rows of both classes there are no trees and every score is the base rate's.
    """

    depth: int = 4
    trees: int = 60
    rate: float = 0.2
    bins: int = 32
    edges: list[np.ndarray] = field(default_factory=list)
    splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def fit(self, x: np.ndarray, y: np.ndarray, min_rows: float = 4.0, ridge: float = 1.0, start: np.ndarray | None = None) -> "BoostedTrees":
        """``start``: scores of another model to go on from; then ``score`` is what to add to them."""
        x, y = np.asarray(x, float), np.asarray(y, float)
        quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = []
        for column in x.T:
            values = np.unique(column)
            # Few values: a cut between each two. Many: cuts at quantiles.
            few = len(values) <= self.bins
            self.edges.append((values[1:] + values[:-1]) / 2 if few else np.unique(np.quantile(column, quantiles)))
        binned, width = self._bin(x), self.bins + 1
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base = 0.0 if start is not None else float(np.log(share / (1 - share)))
        score = np.full(len(y), self.base) if start is None else np.array(start, float)
        for _ in range(self.trees if 0 < y.sum() < len(y) else 0):
            p = sigmoid(score)
            slope, bend = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            features, cuts = np.zeros(self.depth, np.int64), np.full(self.depth, width, np.int64)
            for level in range(self.depth):
                nodes, best = 1 << level, 1e-9
                for j in range(x.shape[1]):
                    at = node * width + binned[:, j]
                    g = np.bincount(at, slope, nodes * width).reshape(nodes, width).cumsum(axis=1)
                    h = np.bincount(at, bend, nodes * width).reshape(nodes, width).cumsum(axis=1)
                    n = np.bincount(at, minlength=nodes * width).reshape(nodes, width).cumsum(axis=1)
                    gt, ht, nt = g[:, -1:], h[:, -1:], n[:, -1:]
                    gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
                    gain[(n < min_rows) | (nt - n < min_rows)] = 0
                    total = gain.sum(axis=0)
                    top = int(total.argmax())
                    if total[top] > best:
                        best, features[level], cuts[level] = float(total[top]), j, top
                node = node * 2 + (binned[:, features[level]] > cuts[level])
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, slope, leaves) / (np.bincount(node, bend, leaves) + ridge)
            self.splits.append((features, cuts, value))
            score += value[node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if not self.splits:
            return total
        binned = self._bin(np.asarray(x, float))
        powers = (1 << np.arange(self.depth)[::-1]).astype(np.int16)
        for features, cuts, value in self.splits:
            total += value[(binned[:, features] > cuts) @ powers]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale[0] * self.score(x) + self.scale[1])

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        """Fit slope and shift of the score on held-out rows, so that ``probability`` means what it says."""
        self.scale = calibration(self.score(x), np.asarray(y, float))
        return self


def calibration(s: np.ndarray, y: np.ndarray, rounds: int = 200, prior: float = 1.0) -> tuple[float, float]:
    """Slope and shift of scores ``s`` on rows ``y``; the fewer the rows, the nearer to 1 and 0."""
    a, b = 1.0, 0.0
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(rounds):
        p = sigmoid(a * s + b)
        w, d = np.maximum(p * (1 - p), 1e-9), goal - p
        hessian = np.array([[(w * s * s).sum() + prior, (w * s).sum()], [(w * s).sum(), w.sum() + prior]])
        step = np.linalg.solve(hessian, [(d * s).sum() + prior * (1 - a), d.sum() - prior * b])
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def best_threshold(probability: np.ndarray, y: np.ndarray, prior: float = 20.0) -> float:
    """The threshold of the highest F1 on held-out rows, midway where a range of them is as good; the fewer the rows, the nearer to a half."""
    if not len(y) or not y.sum():
        return 0.5
    order = np.argsort(-probability, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    low = probability[order[top[-1]]]
    below = probability[order[top[-1] + 1]] if top[-1] + 1 < len(y) else 0.0
    best = float(np.clip((low + below) / 2, 0.2, 0.8))
    return (len(y) * best + prior * 0.5) / (len(y) + prior)
