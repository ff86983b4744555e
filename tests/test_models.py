from __future__ import annotations

import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from tempolith.plans import model_frames, models, resampling

CUTOFFS = (datetime(2016, 1, 1), datetime(2017, 1, 1))


@pytest.fixture(scope="module")
def frame(spark):
    rng, rows = random.Random(1), []
    for i in range(1600):
        link = rng.choice([None, 0, 1, 3, 8])
        late = float(rng.random() < 0.2 + 0.06 * (link or 0))
        created = datetime(2014 + i % 5, 1 + i % 12, 1 + i % 28)
        rows.append((i, "creation", created, None, 1.0, late, rng.choice("ab"), "jira_review", rng.choice(["x", "y", None]), link, rng.random()))
    df = spark.createDataFrame(rows, "issue_key long, point string, created timestamp_ntz, resolution_date timestamp_ntz, threshold_days double, is_late double, project_key string, workflow_family string, issue_type string, link_count int, priority_rank double")
    kinds = model_frames.feature_columns("creation")
    missing = [c for c in (*kinds["log"], *kinds["linear"]) if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast("double") for c in missing}).cache()


def test_models_after_observations(spark, frame):
    """A session that observed something while it wrote still scores."""
    seen = Observation("rows")
    frame.observe(seen, F.count("*").alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 1600
    assert models.fit("logistic", "creation", frame, {"C": 0.3}).score(frame).filter("score between 0 and 1").count() == 1600


def test_known_at(spark):
    day = lambda n: datetime(2020, 1, n)
    rows = [(0, day(1), day(5), 30.0, 1.0), (1, day(1), None, 3.0, 1.0), (2, day(1), None, 30.0, 1.0), (3, day(12), None, 1.0, 1.0), (4, day(1), day(20), 30.0, 0.0), (5, day(1), day(5), 3.0, None)]
    df = spark.createDataFrame(rows, "i int, created timestamp_ntz, resolution_date timestamp_ntz, threshold_days double, is_late double")
    assert sorted(r["i"] for r in model_frames.known_at(df, day(10)).collect()) == [0, 1]


@pytest.mark.parametrize(("kind", "params"), [("logistic", {"C": 0.3}), ("boosting", {"step": 0.1, "depth": 3, "rounds": 10})])
def test_models_learn_and_are_calibrated(frame, kind, params):
    model, calibrate = models.fit_calibrated(kind, "creation", frame, params, datetime(2018, 1, 1), CUTOFFS)
    rows = calibrate(model.score(frame.filter("created >= '2018-01-01'")))
    assert models.average_precision_of(rows) > 1.2 * rows.agg(F.avg("is_late")).first()[0]
    low, high = rows.agg(F.min("calibrated"), F.max("calibrated")).first()
    assert 0 <= low < high <= 1
    # an isotonic map: never falling along the score, and right on average
    pairs = sorted((r["score"], r["calibrated"]) for r in rows.collect())
    assert all(a[1] <= b[1] + 1e-12 for a, b in zip(pairs, pairs[1:], strict=False))
    assert abs(np.mean([c for _, c in pairs]) - rows.agg(F.avg("is_late")).first()[0]) < 0.1


@pytest.mark.parametrize(("kind", "params"), [("logistic", {"C": 0.3}), ("boosting", {"step": 0.1, "depth": 3, "rounds": 6})])
def test_saved_models_score_alike(spark, frame, kind, params, tmp_path):
    model = models.fit(kind, "creation", frame, params)
    models.save(model, f"{tmp_path}/m")
    again = models.load(spark, f"{tmp_path}/m")
    one, two = ({r["issue_key"]: r["score"] for r in m.score(frame).collect()} for m in (model, again))
    assert one == two and again.numbers == model.numbers
    models.write_predictions(model.score(frame), f"{tmp_path}/p")
    assert {r["issue_key"]: r["score"] for r in spark.read.parquet(f"{tmp_path}/p").collect()} == one


def test_boosting_stops_early(frame):
    trees = models.fit("boosting", "creation", frame.withColumn("link_count", F.lit(1)), {"step": 1.0, "depth": 2, "rounds": 30}).pipeline.stages[-1].getNumTrees
    assert trees < 30


def test_tuning_picks_the_best_mean(frame):
    best, found = models.tune("logistic", "creation", frame, CUTOFFS, ({"C": 1e-6}, {"C": 1.0}))
    assert best == max(found, key=lambda f: f["mean"])["params"] and all(len(f["folds"]) == 2 for f in found)


def test_contributions_add_up(frame):
    model = models.fit("logistic", "creation", frame, {"C": 0.3})
    parts = {r["issue_key"]: r["s"] for r in model.contributions(frame, ["issue_key"]).groupBy("issue_key").agg(F.sum("contribution").alias("s")).collect()}
    intercept = model.pipeline.stages[-1].intercept
    for r in model.score(frame).limit(200).collect():
        assert np.log(r["score"] / (1 - r["score"])) == pytest.approx(parts[r["issue_key"]] + intercept, abs=1e-6)


def test_bootstrap_is_paired(spark):
    rng = random.Random(2)
    rows = [(i, y := int(rng.random() < 0.3), round(y + rng.random(), 2), round(rng.random(), 2)) for i in range(1500)]
    df = spark.createDataFrame(rows, "i long, y int, weak double, strong double").select("i", "y", F.col("strong").alias("noise"), F.col("weak").alias("signal"))
    found = {r["name"]: r for r in resampling.intervals(resampling.bootstrap(df, "y", ["noise", "signal"], "i", 40), ["noise", "signal"]).collect()}
    assert found["signal - noise"]["wins"] and found["noise"]["wins"] is None
    assert found["noise"]["low"] < 0.3 < found["noise"]["high"] + 0.05 and found["signal"]["low"] > 0.5


def plain_precision(rows, times):
    """Average precision of (score, y), each row as often as given, ties together."""
    total = sum(t for (_, y), t in zip(rows, times, strict=True) if y)
    out = 0.0
    for s in sorted({s for s, _ in rows}):
        above = [(y, t) for (score, y), t in zip(rows, times, strict=True) if score >= s]
        own = sum(t for (score, y), t in zip(rows, times, strict=True) if score == s and y)
        n, pos = sum(t for _, t in above), sum(t for y, t in above if y)
        out += own * pos / n if n else 0.0
    return out / total if total else None


@pytest.mark.parametrize(("slice_rows", "held"), [(10**6, 1 << 21), (100, 90)])
def test_bootstrap_equals_plain_version(spark, monkeypatch, slice_rows, held):
    monkeypatch.setattr(resampling, "DRAWS", held)
    rng = random.Random(8)
    rows = [(i, rng.choice([0, 1, None]), rng.choice([0.5, 0.5, 0.25, round(rng.random(), 2), None]), rng.choice([-1e9, 3.0, rng.random()])) for i in range(700)]
    df = spark.createDataFrame(rows, "i long, y int, a double, b double").repartition(3)
    found = {r["replicate"]: r for r in resampling.bootstrap(df, "y", ["a", "b"], "i", 6, bits=F.col("i") * 7919, slice_rows=slice_rows).collect()}
    assert sorted(found) == list(range(1, 7))
    times = resampling.draws(np.array([i * 7919 for i, *_ in rows]), 6)
    for name, at in (("a", 2), ("b", 3)):
        some = [k for k, r in enumerate(rows) if r[1] is not None and r[at] is not None]
        for replicate in range(1, 7):
            expected = plain_precision([(rows[k][at], rows[k][1]) for k in some], [times[k][replicate - 1] for k in some])
            assert found[replicate][name] == pytest.approx(expected, rel=1e-12)


def test_draws_are_poisson():
    times = resampling.draws(np.arange(4000) * 2654435761 % 2**32, 500)
    share = np.bincount(times.ravel(), minlength=6)[:6] / times.size
    assert share == pytest.approx([np.exp(-1) / math.factorial(k) for k in range(6)], abs=2e-3)
    assert abs(np.corrcoef(times[:, 0], times[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(times[:-1, 0], times[1:, 0])[0, 1]) < 0.06


def test_many_rows_of_one_score_travel_as_one(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), F.lit(0.5).alias("s"))
    sent = df.coalesce(1).select(F.lit(0).alias("model"), "s", "y", "id").mapInArrow(resampling._gathered(20), resampling._SENT).collect()
    assert len(sent) == 1 and len(sent[0]["n"]) == 20
    assert resampling.bootstrap(df, "y", ["s"], "id", 20).agg(F.avg("s")).first()[0] == pytest.approx(1 / 3, abs=0.02)
