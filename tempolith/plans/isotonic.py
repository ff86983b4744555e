"""Isotonic calibration: adjacent violators are pooled within slices of the scores, then the few pools that are left."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.tables import settle

#: Distinct scores that a task pools, about.
SLICE_SCORES = 500_000
#: Pools that one task joins. Rising shares of whole numbers have long denominators, so N rows leave some N ** (2 / 3) at most.
POOLS = 4_000_000

_POOL = "low double, high double, n double, pos double"


def pooled(low: np.ndarray, high: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbours joined, in order of score, until the shares pos / n rise strictly. What is joined in parts first ends as the same pools."""
    stack: list[list[float]] = []
    for pool in zip(low.tolist(), high.tolist(), n.tolist(), pos.tolist(), strict=True):
        stack.append(list(pool))
        while len(stack) > 1 and stack[-2][3] * stack[-1][2] >= stack[-1][3] * stack[-2][2]:
            _, high_, n_, pos_ = stack.pop()
            stack[-1][1:] = high_, stack[-1][2] + n_, stack[-1][3] + pos_
    return tuple(np.array(stack, float).reshape(-1, 4).T)


def _pool_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pools of a partition sorted by score."""
    held: tuple[np.ndarray, ...] = tuple(np.empty(0) for _ in range(4))
    for batch in batches:
        held = pooled(*(np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)))
    yield pa.RecordBatch.from_arrays([pa.array(h) for h in held], names=["low", "high", "n", "pos"])


def pools(scored: DataFrame, label: str, score: str, slice_scores: int = SLICE_SCORES) -> DataFrame:
    """(low, high, n, pos): ranges of scores of one calibrated value, pos / n, which rises; null labels and scores are left out.

    Equal scores are counted first. Slices of the scores pool by themselves, as pooling may begin anywhere.
    """
    rows = scored.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    counts = rows.groupBy(F.col(score).cast("double").alias("low")).agg(F.count("*").cast("double").alias("n"), F.sum(F.col(label).cast("double")).alias("pos"))
    counts = settle(counts.select("low", F.col("low").alias("high"), "n", "pos"), "scores")
    slices = -(-counts.count() // slice_scores)
    if slices > 1:
        counts = settle(counts.repartitionByRange(slices, "low").sortWithinPartitions("low").mapInArrow(_pool_partition, _POOL), "pools")
        if (left := counts.count()) > POOLS:
            raise ValueError(f"{left} pools are left of {slices} slices")
    return settle(counts.repartition(1).sortWithinPartitions("low").mapInArrow(_pool_partition, _POOL), "pools")


@dataclass(frozen=True)
class Isotonic:
    """A map from scores to calibrated chances: level within a pool, straight lines between them, level beyond the ends."""

    at: np.ndarray
    value: np.ndarray

    @classmethod
    def fit(cls, scored: DataFrame, label: str, score: str, slice_scores: int = SLICE_SCORES) -> Isotonic:
        rows = pools(scored, label, score, slice_scores).orderBy("low").toArrow()
        low, high, n, pos = (rows[c].to_numpy() for c in ("low", "high", "n", "pos"))
        ends, value = np.stack([low, high], axis=1).ravel(), np.repeat(pos / n, 2)
        first = np.append(len(ends) > 0, np.diff(ends) > 0)[: len(ends)]  # a pool of one score has one end
        return cls(ends[first], value[first])

    def apply(self, rows: DataFrame, score: str, name: str = "calibrated") -> DataFrame:
        """``rows`` with the calibrated chance; null where the score is."""
        at, value, given = self.at, self.value, rows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s = batch.column(score).cast(pa.float64())
                known = s.is_valid().to_numpy(zero_copy_only=False)
                out = np.interp(s.fill_null(0.0).to_numpy(), at, value) if len(at) else np.full(len(s), np.nan)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.clip(out, 0.0, 1.0), mask=~known | np.isnan(out))], names=[*given, name])

        return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, DoubleType())]))
