"""Exact Shapley values of boosted trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial, prod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest difference between a row's parts and its log-odds.
TOLERANCE = 1e-6


@dataclass(frozen=True)
class Condition:
    """What a path asks of one feature: above ``low``, at most ``high``, and one of ``allowed`` if that is given."""

    feature: int
    low: float = -np.inf
    high: float = np.inf
    allowed: frozenset[float] | None = None
    share: float = 1.0

    def met(self, values: np.ndarray) -> np.ndarray:
        inside = (values > self.low) & (values <= self.high)
        return inside if self.allowed is None else inside & np.isin(values, list(self.allowed))


@dataclass(frozen=True)
class Leaf:
    value: float
    conditions: tuple[Condition, ...]


def leaves(model) -> list[Leaf]:
    """The leaves of a fitted GBTClassifier, values as log-odds; as many as the trees have, a bound set by their depth.

    Each of a leaf's conditions has the share of training rows that follow the path at that feature's splits.
    """
    found: list[Leaf] = []

    def walk(node, weight: float, conditions: dict[int, Condition]) -> None:
        if node.numDescendants() == 0:
            found.append(Leaf(2 * weight * node.prediction(), tuple(conditions.values())))
            return
        split, cover = node.split(), node.impurityStats().count()
        f = split.featureIndex()
        now = conditions.get(f, Condition(f))
        for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
            low, high, allowed = now.low, now.high, now.allowed
            if split.getClass().getSimpleName() == "ContinuousSplit":
                low, high = (low, min(high, split.threshold())) if left else (max(low, split.threshold()), high)
            else:
                side = frozenset(split.leftCategories() if left else split.rightCategories())
                allowed = side if allowed is None else allowed & side
            share = now.share * child.impurityStats().count() / cover
            walk(child, weight, conditions | {f: Condition(f, low, high, allowed, share)})

    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        walk(tree._call_java("rootNode"), weight, {})
    return found


def mean(of: list[Leaf]) -> float:
    return sum(leaf.value * prod(c.share for c in leaf.conditions) for leaf in of)


def shapley_table(leaf: Leaf) -> np.ndarray:
    """For each pattern of met conditions (bit i: condition i) and each condition, its feature's Shapley value.

    A coalition of features sees the leaf's value times, for each feature in it, 1 or 0 as its condition is met, and for
    each other one its share. The products over coalitions of a size are coefficients of a product of linear factors.
    """
    m = len(leaf.conditions)
    weights = [factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)]
    table = np.zeros((1 << m, m))
    for pattern in range(1 << m):
        met = [pattern >> i & 1 for i in range(m)]
        for i, own in enumerate(leaf.conditions):
            by_size = np.ones(1)
            for j, other in enumerate(leaf.conditions):
                if j != i:
                    by_size = np.convolve(by_size, (other.share, met[j]))
            table[pattern, i] = leaf.value * (met[i] - own.share) * np.dot(weights, by_size)
    return table


def contributions(scored: DataFrame, keys: list[str], of: list[Leaf], origins: list[str]) -> DataFrame:
    """(keys, feature, contribution) of rows with _v, the feature vector, and _raw, half the log-odds.

    Raises where the parts of a row do not add up to its log-odds less the mean.
    """
    names = sorted(set(origins))
    place = {n: i for i, n in enumerate(names)}
    column = [place[n] for n in origins]
    tables = [(leaf, shapley_table(leaf)) for leaf in of if leaf.conditions]
    base = mean(of)

    @F.pandas_udf("array<double>")
    def explain(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for vectors, raw in batches:
            if vectors.empty:
                yield pd.Series([], dtype=object)
                continue
            x, out = np.stack(vectors.to_numpy()), np.zeros((len(vectors), len(names)))
            for leaf, table in tables:
                pattern = np.zeros(len(x), dtype=np.int64)
                for i, c in enumerate(leaf.conditions):
                    pattern |= c.met(x[:, c.feature]).astype(np.int64) << i
                for i, c in enumerate(leaf.conditions):
                    out[:, column[c.feature]] += table[pattern, i]
            gap = np.abs(out.sum(axis=1) + base - 2 * raw.to_numpy()).max()
            if gap > TOLERANCE:
                raise ValueError(f"contributions do not add up to the model's output (largest gap {gap:.2e})")
            yield pd.Series(list(out))

    parts = scored.select(*keys, explain("_v", "_raw").alias("_parts"))
    pair: Column = F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("feature"), F.col("_parts").alias("contribution")))
    return parts.select(*keys, pair.alias("_p")).select(*keys, F.col("_p.feature").alias("feature"), F.col("_p.contribution").alias("contribution"))
