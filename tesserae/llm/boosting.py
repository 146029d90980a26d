"""Small gradient-boosted trees: fitted on the driver on a bounded sample, scored as a column expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    """A tree of depth two: (feature, threshold, left, right), leaves are values; x <= threshold goes left."""

    feature: int
    threshold: float
    left: Tree | float
    right: Tree | float

    def values(self, x: np.ndarray) -> np.ndarray:
        side = lambda s: s.values(x) if isinstance(s, Tree) else np.full(len(x), s)
        return np.where(x[:, self.feature] <= self.threshold, side(self.left), side(self.right))

    def column(self, features: list[Column]) -> Column:
        side = lambda s: s.column(features) if isinstance(s, Tree) else F.lit(float(s))
        return F.when(features[self.feature] <= self.threshold, side(self.left)).otherwise(side(self.right))


@dataclass(frozen=True)
class Model:
    start: float
    trees: tuple[Tree, ...]
    slope: float  # calibration: probability = sigmoid(slope * margin + shift)
    shift: float
    threshold: float  # of the probability

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t.values(x) for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.shift)))

    def column(self, features: list[Column]) -> Column:
        total = F.lit(float(self.start))
        for t in self.trees:
            total = total + t.column(features)
        return 1 / (1 + F.exp(-(total * float(self.slope) + float(self.shift))))


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> tuple[float, int, float]:
    best = (0.0, -1, 0.0)
    whole = g.sum() ** 2 / (h.sum() + 1)
    for f, own in enumerate(cuts):
        for c in own:
            left = x[:, f] <= c
            gl, hl = g[left].sum(), h[left].sum()
            gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - whole
            if gain > best[0] + 1e-9:
                best = (gain, f, float(c))
    return best


def _leaf(g: np.ndarray, h: np.ndarray, rate: float) -> float:
    return float(rate * g.sum() / (h.sum() + 1))


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 30, rate: float = 0.3, precision: float = 0.98) -> Model:
    """Boosting of the logistic loss on two thirds of the rows; the rest calibrates probability and threshold: the
    lowest probability above which ``precision`` of these rows are positive."""
    held = np.arange(len(x)) % 3 == 2
    xt, yt = x[~held], y[~held].astype(float)
    cuts = [np.unique(np.quantile(xt[:, f], np.linspace(0, 1, 17)[1:-1], method="lower")) for f in range(x.shape[1])]
    start = float(np.log((yt.mean() + 1e-6) / (1 - yt.mean() + 1e-6)))
    margin, trees = np.full(len(xt), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = yt - p, p * (1 - p)
        gain, f, c = _split(xt, g, h, cuts)
        if f < 0:
            break
        sides = []
        for own in (xt[:, f] <= c, xt[:, f] > c):
            _, f2, c2 = _split(xt[own], g[own], h[own], cuts)
            if f2 < 0:
                sides.append(_leaf(g[own], h[own], rate))
            else:
                low = own & (xt[:, f2] <= c2)
                high = own & (xt[:, f2] > c2)
                sides.append(Tree(f2, c2, _leaf(g[low], h[low], rate), _leaf(g[high], h[high], rate)))
        tree = Tree(f, c, *sides)
        trees.append(tree)
        margin += tree.values(xt)
    model = Model(start, tuple(trees), 1.0, 0.0, 0.5)
    m, t = model.margin(x[held]), y[held].astype(float)
    # Platt's targets keep the slope finite
    t = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * m + b)))
        w = np.maximum(p * (1 - p), 1e-9)
        grad = np.array([((p - t) * m).sum(), (p - t).sum()])
        hess = np.array([[(w * m * m).sum() + 1e-6, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
    model = Model(start, tuple(trees), float(a), float(b), 0.5)
    p, truth = model.probability(x[held]), y[held] > 0
    for c in np.unique(p):
        if truth[p >= c].mean() >= precision:
            return Model(start, tuple(trees), float(a), float(b), float(max(c, 0.5)))
    return Model(start, tuple(trees), float(a), float(b), 1.1)
