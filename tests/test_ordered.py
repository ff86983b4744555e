"""The time-ordered operators against brute force, with slices so small that keys span many."""

from __future__ import annotations

import random
import statistics
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from tempolith.functions import metrics
from tempolith.operators import ordered
from tempolith.operators.ordered import Source, asof_join, asof_join_simple, asof_joins, next_time, quantiles, ranked, running_sum, trailing, trailing_medians

T0 = datetime(2020, 1, 1)
HOUR = 3600


def moments(rng, n):
    return [T0 + timedelta(hours=rng.randrange(400)) if rng.random() < 0.97 else None for _ in range(n)]


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("join", ["sliced", "simple"])
def test_asof(spark, strict, join):
    rng = random.Random(3)
    left = [(i, rng.choice(["a", "b", "c", "z", None]), t) for i, t in enumerate(moments(rng, 400))]
    right = [(i, rng.choice(["a", "b", "c", None]), t, rng.choice([1.0, 2.0, None])) for i, t in enumerate(moments(rng, 150))]
    frames = spark.createDataFrame(left, "i int, k string, t timestamp_ntz"), spark.createDataFrame(right, "n int, rk string, rt timestamp_ntz, v double")
    f, more = (asof_join, {"seconds": 7 * HOUR}) if join == "sliced" else (asof_join_simple, {})
    rows = f(*frames, {"k": "rk"}, "t", "rt", {"n": "n", "v": "v"}, ["n"], strict=strict, matched="hit", **more).collect()
    assert len(rows) == len(left)
    for r in rows:
        fits = [x for x in right if x[1] is not None and x[1] == r["k"] and r["t"] and x[2] and (x[2] < r["t"] or (x[2] == r["t"] and not strict))]
        best = max(fits, key=lambda x: (x[2], x[0]), default=None)
        assert (r["hit"], r["n"], r["v"]) == ((True, best[0], best[3]) if best else (False, None, None))


def test_next_time(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b", None]), t) for i, t in enumerate(moments(rng, 300))]
    frame = spark.createDataFrame(rows, "i int, k string, t timestamp_ntz")
    found = {r["i"]: r["next"] for r in next_time(frame, ["k"], "t", [F.col("i")], "next", 5 * HOUR).collect()}
    for i, k, t in rows:
        later = min(((u, j) for j, m, u in rows if m == k and t and u and (u, j) > (t, i)), default=(None, None))
        assert found[i] == later[0]


def test_ranked_and_running(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", None]), T0 + timedelta(hours=rng.randrange(300)), rng.choice([1, -1])) for i in range(500)]
    frame = spark.createDataFrame(rows, "i int, k string, t timestamp_ntz, d int")
    for r in ranked(frame, ["k"], "t", [F.col("i")], "n", 9 * HOUR).collect():
        assert r["n"] == 1 + sum(x[1] == r["k"] and (x[2], x[0]) < (r["t"], r["i"]) for x in rows)
    for r in running_sum(frame, ["k"], "t", "d", "s", 9 * HOUR).collect():
        assert r["s"] == sum(x[3] for x in rows if x[1] == r["k"] and x[2] <= r["t"])


def test_trailing_over_blocks(spark):
    rng = random.Random(5)
    rows = [(i, i % 2, T0 + timedelta(hours=rng.randrange(9000)), float(rng.randrange(100))) for i in range(11_000)]
    frame = spark.createDataFrame(rows, "i int, k int, t timestamp_ntz, v double")
    stats = lambda w: {"n": F.count("*").over(w), "mid": F.percentile("v", 0.5).over(w)}
    found = {r["i"]: r for r in trailing(frame, ["k"], "t", [F.col("i")], 20, stats, 300 * HOUR).collect()}
    assert len(found) == len(rows)
    for k in (0, 1):
        own = sorted((x for x in rows if x[1] == k), key=lambda x: (x[2], x[0]))
        for place in [0, 5, 19, 20, *range(4080, 4120), 5499]:
            window = [x[3] for x in own[max(0, place - 19) : place + 1]]
            r = found[own[place][0]]
            assert (r["n"], r["mid"]) == (len(window), float(np.median(window)))


def test_quantiles(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float(rng.randrange(30)), rng.random() * 50])) for _ in range(600)] + [("one", 7.0)]
    shares = {"low": 0.1, "mid": 0.5, "high": 0.75, "top": 1.0}
    for r in quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", shares).collect():
        own = [v for k, v in rows if k == r["k"] and v is not None]
        assert r["n"] == len(own) and all(r[n] == pytest.approx(float(np.quantile(own, s))) for n, s in shares.items())


def test_metrics(spark):
    rng = random.Random(7)
    rows = [(i, int(rng.random() < 0.3), round(rng.random(), 2)) for i in range(400)]
    frame = spark.createDataFrame(rows, "i int, y int, s double")
    counts = metrics.score_counts(frame, "y", "s").groupBy("_one").agg(metrics.average_precision().alias("ap"), metrics.roc_auc().alias("auc")).first()
    positive, negative = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in positive for n in negative) / len(positive) / len(negative)
    cuts = sorted({s for _, _, s in rows}, reverse=True)
    recall = [sum(p >= c for p in positive) / len(positive) for c in [2.0, *cuts]]
    ap = sum((recall[k + 1] - recall[k]) * sum(p >= c for p in positive) / sum(s >= c for _, _, s in rows) for k, c in enumerate(cuts))
    assert counts["auc"] == pytest.approx(auc) and counts["ap"] == pytest.approx(ap)
    top = metrics.top_fraction(frame, "y", "s", F.col("i")).first()
    best = sorted(rows, key=lambda r: (-r[2], r[0]))[:40]
    assert top["k"] == 40 and top["precision"] == pytest.approx(sum(y for _, y, _ in best) / 40)
    table = metrics.calibration_table(frame, "y", "s", "i").orderBy("bin").collect()
    assert [r["n"] for r in table] == [40] * 10 and [r["predicted"] for r in table] == sorted(r["predicted"] for r in table)


def plain_latest(rows, at, strict, tie):
    found = [r for r in rows if r[0] is not None and (r[0] < at if strict else r[0] <= at)]
    return max(found, key=lambda r: (r[0], (tie(r) is not None, tie(r))), default=None)


def test_several_sources_in_one_pass(spark):
    rng = random.Random(3)
    t = lambda: rng.choice([None, *(datetime(2020, 1, 1) + timedelta(hours=rng.randrange(4000)) for _ in range(9))])
    asks = [(i, rng.choice(["a", "b", None, "c"]), t()) for i in range(300)]
    loads = [(rng.choice(["a", "b", None, "d"]), t(), rng.choice([None, i])) for i in range(200)]
    marks = [(rng.choice(["a", "b", "c"]), t(), i, rng.choice([None, i % 5])) for i in range(200)]
    left = spark.createDataFrame(asks, "i int, k string, t timestamp_ntz")
    first = Source(spark.createDataFrame(loads, "key string, ts timestamp_ntz, n int"), ["key"], "ts", {"n": "load"}, ["n"], matched="found")
    second = Source(spark.createDataFrame(marks, "key string, at timestamp_ntz, n int, v int"), ["key"], "at", {"v": "v", "n": "mark"}, ["n"], strict=True)
    found = {r["i"]: r for r in asof_joins(left, ["k"], "t", [first, second], seconds=7 * 86_400).collect()}
    assert len(found) == 300
    for i, key, at in asks:
        a = b = None
        if key is not None and at is not None:
            a = plain_latest([(ts, n) for k, ts, n in loads if k == key], at, False, lambda r: r[1])
            b = plain_latest([(ts, n, v) for k, ts, n, v in marks if k == key], at, True, lambda r: r[1])
        assert (found[i]["load"], found[i]["found"], found[i]["mark"], found[i]["v"]) == (a and a[1], a is not None, b and b[1], b and b[2])


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_two_sources_take_as_many_exchanges_as_one(spark):
    left = spark.createDataFrame([(1, "a", datetime(2020, 1, 1))], "i int, k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", datetime(2020, 1, 1), 1)], "key string, ts timestamp_ntz, n int")
    source = lambda n: Source(right, ["key"], "ts", {"n": n}, ["n"])
    one, two = (asof_joins(left, ["k"], "t", [source(n) for n in names]) for names in (["a"], ["a", "b"]))
    assert exchanges(one) == exchanges(two) <= 3


def test_sliding_medians(spark):
    rng = random.Random(4)
    rows = [(k, datetime(2020, 1, 1) + timedelta(hours=rng.randrange(3000)), i, rng.choice([None, rng.random(), 0.5]), rng.choice([None, True, False])) for i, k in enumerate(rng.choices(["a", "b", None], [8, 2, 1], k=9000))]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, i int, x double, late boolean")
    found = {r["i"]: r for r in trailing_medians(df, ["k"], "t", [F.col("i")], 150, {"mid": "x"}, {"rate": "late"}, seconds=20 * 86_400).collect()}
    assert len(found) == len(rows)
    for key in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for at, r in enumerate(own):
            frame = own[max(0, at - 149) : at + 1]
            xs, flags = [f[3] for f in frame if f[3] is not None], [f[4] for f in frame if f[4] is not None]
            got = found[r[2]]
            assert got["n"] == len(frame) and got["mid"] == (statistics.median(xs) if xs else None) and got["rate"] == (sum(flags) / len(flags) if flags else None)


@pytest.mark.parametrize("stretch", [2, 40, 1 << 17])
def test_quantiles_of_any_spread(spark, stretch):
    rng = random.Random(5)
    values = {"rates": [rng.random() for _ in range(900)], "wide": [rng.uniform(-1e9, 1e9) for _ in range(700)] + [5.0] * 900, "few": [1.0, 2.0, 2.0], None: [float(i // 3) for i in range(300)], "one": [7.0]}
    rows = [(k, v, rng.randrange(3)) for k, vs in values.items() for v in vs] + [("rates", None, 1), ("none", None, 2)]
    df = spark.createDataFrame(rows, "k string, v double, w int")
    shares = {"low": 0.0, "q": 0.3, "mid": 0.5, "high": 0.975, "top": 1.0}
    found = {r["k"]: r for r in quantiles(df, ["k"], "v", shares, stretch=stretch).collect()}
    assert set(found) == set(values)
    for k, vs in values.items():
        assert found[k]["n"] == len(vs) and [found[k][n] for n in shares] == pytest.approx([np.quantile(vs, s) for s in shares.values()], rel=1e-12)
    weighted = {r["k"]: r for r in quantiles(df, ["k"], "v", {"mid": 0.5}, weight=F.col("w"), stretch=stretch).collect()}
    for k in weighted:
        vs = [v for key, v, w in rows if key == k and v is not None for _ in range(w)]
        assert weighted[k]["n"] == len(vs) and weighted[k]["mid"] == pytest.approx(np.median(vs), rel=1e-12)


def test_no_stretch_is_larger_than_asked(spark, monkeypatch):
    seen = []
    plain = ordered._at_places
    monkeypatch.setattr(ordered, "_at_places", lambda rows, spot, *more, **named: (seen.append(rows.groupBy(*spot).count().agg(F.max("count")).first()[0]), plain(rows, spot, *more, **named))[1])
    df = spark.range(20_000).select((F.col("id") * 0.00005).alias("rate"), (F.col("id") * 1e9).alias("far"), F.lit("k").alias("k"))
    for column in ("rate", "far"):
        quantiles(df, ["k"], column, {"a": 0.25, "b": 0.9}, stretch=100).collect()
    assert max(n for n in seen if n is not None) <= 100
