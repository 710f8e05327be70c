"""Gradient-boosted trees over a table of counts, and their form as a SQL expression.

The table has one row for each distinct vector of small integer features with how often it was
positive and negative.  Its size is bounded by the product of the features' ranges, not by the
corpus, so trees are grown on the driver from statistics of all data; they are applied as
nested CASE expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Row = tuple[tuple[int, ...], float, float]  # features, positives, negatives


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    feature: int
    at: int  # up to this value goes to the left
    left: Leaf | Split
    right: Leaf | Split


def value(node: Leaf | Split, x: tuple[int, ...]) -> float:
    while isinstance(node, Split):
        node = node.left if x[node.feature] <= node.at else node.right
    return node.value


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, l2: float) -> Leaf | Split:
    """x: a row of features for each vector; g, h: gradients and hessians."""
    gs, hs = g.sum(), h.sum()
    best, choice = 1e-6, None
    for f in range(x.shape[1] if depth and len(x) > 1 else 0):
        # sums by value of the feature, then over all values up to it
        gl, hl = np.cumsum(np.bincount(x[:, f], g)), np.cumsum(np.bincount(x[:, f], h))
        gr, hr = gs - gl, hs - hl
        gain = gl * gl / (hl + l2) + gr * gr / (hr + l2) - gs * gs / (hs + l2)
        gain[np.minimum(hl, hr) < 0.5] = 0
        at = int(np.argmax(gain))
        if gain[at] > best:
            best, choice = gain[at], (f, at)
    if choice is None:
        return Leaf(float(-rate * gs / (hs + l2)))
    f, at = choice
    left = x[:, f] <= at
    return Split(f, at, *(_grow(x[k], g[k], h[k], depth - 1, rate, l2) for k in (left, ~left)))


def _values(node: Leaf | Split, x: np.ndarray) -> np.ndarray:
    if isinstance(node, Leaf):
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.at, _values(node.left, x), _values(node.right, x))


@dataclass
class Boosted:
    """Log odds as a base plus trees, and the probability from which a candidate is selected."""

    base: float
    trees: list
    threshold: float

    def probability(self, x: tuple[int, ...]) -> float:
        return 1 / (1 + math.exp(-self.base - sum(value(t, x) for t in self.trees)))

    def column(self, features: list[Column]) -> Column:
        def of(node):
            if isinstance(node, Leaf):
                return F.lit(float(node.value))
            return F.when(features[node.feature] <= node.at, of(node.left)).otherwise(of(node.right))

        odds = F.lit(float(self.base))
        for tree in self.trees:
            odds = odds + of(tree)
        return 1 / (1 + F.exp(-odds))


def fit(rows: list[Row], precision: float, held: list[Row] | None = None, trees: int = 20, depth: int = 3, rate: float = 0.4, l2: float = 1.0) -> Boosted:
    """Newton boosting on the logistic loss, then the least threshold that keeps ``precision``.

    The precision of a threshold is a lower bound (one standard error) over the counts of ``held``, rows that
    the trees have not seen (of rows themselves if there are none), at or above it.  Without
    any row, or if no threshold will do, nothing is ever selected.
    """
    rows = sorted(r for r in rows if r[1] or r[2])
    if not any(r[1] for r in rows):
        return Boosted(0.0, [], 2.0)
    x = np.array([r[0] for r in rows], np.int64).reshape(len(rows), -1)
    pos, neg = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    base = math.log((pos.sum() + 0.5) / (neg.sum() + 0.5))
    odds, grown = np.full(len(rows), base), []
    for _ in range(trees if neg.any() else 0):
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        n = pos + neg
        grown.append(_grow(x, n * p - pos, n * p * (1 - p), depth, rate, l2))
        odds = odds + _values(grown[-1], x)
    model = Boosted(base, grown, 2.0)
    scored = sorted(((model.probability(r[0]), r[1], r[2]) for r in (rows if held is None else held) if r[1] or r[2]), reverse=True)
    a = b = 0.0
    for k, (q, up, down) in enumerate(scored):
        a, b = a + up, b + down
        if k + 1 < len(scored) and scored[k + 1][0] == q:
            continue
        share = a / (a + b)
        if share - math.sqrt(share * (1 - share) / (a + b)) - 0.5 / (a + b) >= precision:
            model.threshold = q
    return model
