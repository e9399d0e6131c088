"""Gradient-boosted trees of depth two, trained in numpy, applied as Columns.

Training sets here are small and bounded (thousands of generated examples), so
an exact split search over quantile cut points is enough.  A fitted model turns
into nested CASE expressions; scoring then stays inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A split (``feature``, ``cut``: left if value <= cut) or a leaf (``value``)."""

    feature: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None
    value: float = 0.0


def _grow(x, grad, hess, cuts, depth: int, rate: float, ridge: float = 1.0) -> Node:
    total_g, total_h = grad.sum(), hess.sum()
    leaf = Node(value=float(rate * total_g / (total_h + ridge)))
    if depth == 0 or len(x) < 20:
        return leaf
    best, found = total_g**2 / (total_h + ridge) + 1e-6, None
    for j, points in enumerate(cuts):
        for cut in points:
            low = x[:, j] <= cut
            g, h = grad[low].sum(), hess[low].sum()
            gain = g * g / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge)
            if gain > best:
                best, found = gain, (j, cut, low)
    if found is None:
        return leaf
    j, cut, low = found
    return Node(j, float(cut), _grow(x[low], grad[low], hess[low], cuts, depth - 1, rate), _grow(x[~low], grad[~low], hess[~low], cuts, depth - 1, rate))


def _value(node: Node, x) -> np.ndarray:
    if node.left is None:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.cut, _value(node.left, x), _value(node.right, x))


@dataclass(frozen=True)
class BoostedTrees:
    """A sum of trees on the log-odds scale and the calibrated threshold."""

    trees: tuple[Node, ...]
    threshold: float

    def margin(self, x) -> np.ndarray:
        return sum((_value(t, x) for t in self.trees), np.zeros(len(x)))

    def column(self, features: list[Column]) -> Column:
        """The log-odds of a row as a Column."""

        def of(node: Node) -> Column:
            if node.left is None:
                return F.lit(node.value)
            return F.when(features[node.feature] <= node.cut, of(node.left)).otherwise(of(node.right))

        total = F.lit(0.0)
        for tree in self.trees:
            total = total + of(tree)
        return total


def fit(x, y, rounds: int = 15, rate: float = 0.4, depth: int = 2, cuts: int = 8) -> tuple[Node, ...]:
    """Boost ``rounds`` trees on the logistic loss."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    points = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, cuts + 2)[:-1])) for j in range(x.shape[1])]
    margin, trees = np.zeros(len(x)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, y - p, p * (1 - p), points, depth, rate)
        trees.append(tree)
        margin += _value(tree, x)
    return tuple(trees)


def calibrated(x, y, held_x, held_y, precision: float = 0.98, **how) -> BoostedTrees:
    """Fit, then take the lowest threshold whose held-out precision suffices."""
    trees = fit(x, y, **how)
    margins = BoostedTrees(trees, 0.0).margin(np.asarray(held_x, float))
    held_y = np.asarray(held_y, float)
    order = np.argsort(-margins)
    exact = np.cumsum(held_y[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(exact >= precision)
    return BoostedTrees(trees, float(margins[order[good[-1]]]) if len(good) else float("inf"))
