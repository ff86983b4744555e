from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F
from tempolith.plans.isotonic import Isotonic, pooled


def min_max(scores):
    """For each place the greatest, over starts up to it, of the least mean, over ends from it on."""
    out = []
    for i in range(len(scores)):
        mean = lambda a, b: sum(p for _, p in scores[a : b + 1]) / sum(n for n, _ in scores[a : b + 1])
        out.append(max(min(mean(a, b) for b in range(i, len(scores))) for a in range(i + 1)))
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 5), st.integers(0, 5)).map(lambda t: (t[0], min(t))), min_size=1, max_size=12), st.integers(1, 6))
def test_pools_of_parts_are_those_of_the_whole(scores, cut):
    s = np.arange(len(scores), dtype=float)
    n, pos = (np.array(x, float) for x in zip(*scores, strict=True))
    whole = pooled(s, s, n, pos)
    parts = [pooled(s[at : at + cut], s[at : at + cut], n[at : at + cut], pos[at : at + cut]) for at in range(0, len(s), cut)]
    joined = pooled(*(np.concatenate([p[k] for p in parts]) for k in range(4)))
    assert all(np.allclose(a, b) for a, b in zip(whole, joined, strict=True)) and len(whole[0]) == len(joined[0])
    expected = min_max(scores)
    for low, high, count, late in zip(*whole, strict=True):
        assert all(expected[i] == pytest.approx(late / count) for i in range(int(low), int(high) + 1))


@pytest.mark.parametrize("slice_scores", [10**6, 40])
def test_map_equals_the_library(spark, slice_scores):
    rng = random.Random(4)
    rows = [(s := round(rng.random(), 2 + (k % 2)), float(rng.random() < s)) for k in range(1500)] + [(None, 1.0), (0.5, None)]
    df = spark.createDataFrame(rows, "s double, y double").repartition(4)
    own = Isotonic.fit(df, "y", "s", slice_scores)
    library = IsotonicRegression(featuresCol="s", labelCol="y", predictionCol="p").fit(df.dropna())
    asked = spark.createDataFrame([(x / 137,) for x in range(-20, 160)], "s double")
    found = library.transform(own.apply(asked, "s")).collect()
    assert max(abs(r["calibrated"] - r["p"]) for r in found) < 1e-12
    assert own.apply(spark.createDataFrame([(None,)], "s double"), "s").first()["calibrated"] is None
    assert own.apply(df.limit(0), "s").collect() == [] and Isotonic.fit(df.filter(F.lit(False)), "y", "s").at.size == 0
