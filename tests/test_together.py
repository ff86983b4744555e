"""Models fitted together against single fits: by Newton steps in plain numpy, and by the library's own pipeline."""

from __future__ import annotations

import random
from dataclasses import replace
from datetime import datetime
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F
from tempolith import queries
from tempolith.plans import explain, model_frames, models, together
from tempolith.plans.together import Spec, fit_together, scored_together

CUTOFFS = (datetime(2016, 1, 1), datetime(2017, 1, 1))


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(6), []
    for i in range(1500):
        link, peers = rng.choice([None, 0, 1, 3, 8]), rng.choice([None, rng.random()])
        late = float(rng.random() < 0.15 + 0.05 * (link or 0) + 0.3 * (peers or 0))
        created = datetime(2014 + i % 5, 1 + i % 12, 1 + i % 28)
        kind = rng.choice(["x", "y", None]) if created.year < 2017 else rng.choice(["x", "y", "new", None])
        out.append((i, "creation", created, created.replace(year=created.year + 1) if i % 3 else None, 400.0, late if i % 40 else None, rng.choice("abc"), "jira_review", kind, link, rng.random(), peers, rng.choice([5, 9, None])))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    df = spark.createDataFrame(rows, "issue_key long, point string, created timestamp_ntz, resolution_date timestamp_ntz, threshold_days double, is_late double, project_key string, workflow_family string, issue_type string, link_count int, priority_rank double, peer_late_rate double, title_length int")
    kinds = model_frames.feature_columns("creation")
    missing = [c for c in (*kinds["log"], *kinds["linear"]) if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast("double") for c in missing}).repartition(5).cache()


def plain_fit(rows, C, without=()):
    """Medians, gaps, scales, levels and Newton's steps for rows repeated as often as they count; a function that scores."""
    columns = [("link_count", 9, True), ("priority_rank", 10, False), ("peer_late_rate", 11, False), ("title_length", 12, True)]
    columns = [c for c in columns if c[0] not in without]
    seen = {k: sorted({r[k] for r in rows if r[k] is not None}) for k in (6, 7, 8)}
    facts = []
    for _, k, logged in columns:
        change = (lambda v: np.log1p(max(v, 0.0))) if logged else float
        mid = np.median([r[k] for r in rows if r[k] is not None])
        filled = [change(mid if r[k] is None else r[k]) for r in rows]
        facts.append((k, change, mid, np.mean(filled), np.std(filled) or 1.0))

    def design(some):
        out = []
        for r in some:
            row = [x for k, change, mid, mean, dev in facts for x in ((change(mid if r[k] is None else r[k]) - mean) / dev, float(r[k] is None))]
            row += [float((r[k] if r[k] in levels else None) == level) for k, levels in seen.items() for level in (*levels, None)]
            out.append([*row, 1.0])
        return np.array(out)

    x, y = design(rows), np.array([r[5] for r in rows])
    beta, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], 1 / C)
    penalty[-1] = 0
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag(penalty), x.T @ (p - y) + penalty * beta)
        beta = beta - step
    return lambda some: 1 / (1 + np.exp(-design(some) @ beta))


def test_fits_equal_single_ones(frame, rows):
    early = lambda r: r[2].year < 2017
    specs = [
        Spec("all", F.lit(1), 0.3),
        Spec("early", (F.col("created") < "2017-01-01").cast("int"), 0.03),
        Spec("twice", (F.col("issue_key") % 3).cast("int"), 3.0),
        Spec("less", F.lit(1), 0.3, ("link_count", "peer_late_rate")),
        Spec("one class", (F.col("is_late") == 1).cast("int"), 1.0),
        Spec("none", F.lit(None).cast("int"), 1.0),
    ]
    found = fit_together(frame, "creation", specs)
    assert found[4] is None and found[5] is None
    known = [r for r in rows if r[5] is not None]
    plain = [plain_fit(known, 0.3), plain_fit([r for r in known if early(r)], 0.03), plain_fit([r for r in known for _ in range(r[0] % 3)], 3.0), plain_fit(known, 0.3, ("link_count", "peer_late_rate"))]
    got = {r["issue_key"]: r["scores"] for r in scored_together(frame, found[:4]).collect()}
    for j, score in enumerate(plain):
        assert np.abs(np.array([got[r[0]][j] for r in rows]) - score(rows)).max() < 1e-6
    # and one at a time
    for spec, model in list(zip(specs, found, strict=True))[:3]:
        alone = fit_together(frame, "creation", [spec])[0]
        assert np.abs(alone.weights[:8] - model.weights[:8]).max() < 1e-6


def test_fit_equals_the_pipeline(frame, monkeypatch):
    monkeypatch.setattr(models, "LogisticRegression", lambda **named: LogisticRegression(**named | {"tol": 1e-14, "maxIter": 1000}))
    known = frame.filter("is_late is not null")
    single = {r["issue_key"]: r["score"] for r in models.fit("logistic", "creation", known, {"C": 0.3}).score(frame).select("issue_key", "score").collect()}
    model = fit_together(frame, "creation", [Spec("all", F.lit(1), 0.3)])
    scored = {r["issue_key"]: r["scores"][0] for r in scored_together(frame, model).collect()}
    assert max(abs(scored[i] - single[i]) for i in scored) < 1e-6


def test_contributions_add_up(frame):
    found = fit_together(frame, "creation", [Spec("a", F.lit(1), 0.3), Spec("b", F.col("issue_key") % 2, 3.0)])
    scores = {r["issue_key"]: r["scores"] for r in scored_together(frame, found).collect()}
    sums = together.contributions_together(frame, ["issue_key"], found).groupBy("issue_key", "model").agg(F.sum("contribution").alias("s"), F.count("*").alias("n")).collect()
    assert len(sums) == 2 * len(scores) and {r["n"] for r in sums} == {17}
    for r in sums:
        model = found["ab".index(r["model"])]
        p = scores[r["issue_key"]]["ab".index(r["model"])]
        assert np.log(p / (1 - p)) == pytest.approx(r["s"] + model.base(), abs=1e-9)
    sizes = together.importance_together(frame, found)
    plain = {(r["model"], r["feature"]): r["m"] for r in together.contributions_together(frame, ["issue_key"], found).groupBy("model", "feature").agg(F.avg(F.abs("contribution")).alias("m")).collect()}
    assert all(sizes[m][f] == pytest.approx(v, abs=1e-12) for (m, f), v in plain.items())


def test_a_step_is_one_pass(frame, monkeypatch):
    """As many passes for nine models as for one, give or take a step."""
    passes = []
    plain = together._slopes
    monkeypatch.setattr(together, "_slopes", lambda *a: (passes.append(len(a[2])), plain(*a))[1])
    fit_together(frame, "creation", [Spec("a", F.lit(1), 0.3)])
    one = len(passes)
    passes.clear()
    fit_together(frame, "creation", [Spec(f"{k}", F.col("issue_key") % (k + 2), 0.3) for k in range(9)])
    assert len(passes) <= one + 3 and passes[0] == 9


def test_tuning_equals_single_folds(frame):
    found = {(r["c"], r["cutoff"]): r for r in together.tune_together("creation", frame, CUTOFFS, (0.03, 3.0), 200, 50).collect()}
    assert len(found) == 4
    for cutoff, train, valid in model_frames.folds(frame, CUTOFFS):
        for C in (0.03, 3.0):
            single = fit_together(train, "creation", [Spec("s", F.lit(1), C)])
            ap = models.average_precision_of(scored_together(valid, single).withColumn("s", F.col("scores")[0]), "is_late", "s")
            r = found[C, cutoff]
            assert r["average_precision"] == pytest.approx(ap, abs=1e-9) and (r["n_train"], r["n_valid"]) == (train.count(), valid.count())
    best, scores = models.tune("logistic", "creation", frame, CUTOFFS)
    assert len(scores) == 3 and best == max(scores, key=lambda s: s["mean"])["params"]


def test_tuning_with_one_fold_or_none(frame):
    """Of two folds one may be too small, or both."""
    both = together.tune_together("creation", frame, CUTOFFS, (0.3,), 200, 50).filter(F.col("cutoff") == CUTOFFS[1]).first()
    assert together.tune_together("creation", frame, CUTOFFS[1:], (0.3,), 200, 50).collect() == [both]
    assert together.tune_together("creation", frame.limit(0), CUTOFFS, (0.3,), 200, 50).collect() == []


def test_refits_together(frame):
    train = frame.filter("is_late is not null")
    found = explain.stability_together("creation", train, train, 0.3, "issue_key", CUTOFFS, replicates=3)
    assert [next(iter(f)) for f in found] == ["resample"] * 3 + ["known_at"] * 2 and all(0 < f["spearman"] <= 1 and 0 <= f["top3_overlap"] <= 3 for f in found)
    out = {r["name"]: r for r in explain.ablations("logistic", "creation", train, train, {"C": 0.3}, {"all": (), "no_links": ("link_count",)})}
    assert out["all"]["average_precision"] > out["no_links"]["average_precision"] and out["all"]["roc_auc"] > 0.5


def test_refits_without_a_model(frame):
    """Where a class is missing, from all rows or from what was known at a cutoff, there is a row without numbers."""
    train = frame.filter("is_late is not null")
    late = explain.stability_together("creation", train.filter("is_late = 1"), train, 0.3, "issue_key", CUTOFFS, replicates=2)
    assert [(f["spearman"], f["top3_overlap"], f["top3"]) for f in late] == [(None, None, None)] * 4
    some = explain.stability_together("creation", train, train, 0.3, "issue_key", (datetime(2013, 1, 1), CUTOFFS[1]), replicates=1)
    assert [f["spearman"] is None for f in some] == [False, True, False] and [f.get("known_at") for f in some][1:] == [datetime(2013, 1, 1), CUTOFFS[1]]


def test_queries_without_a_model(spark, frame):
    """No ticket was known at the cutoff: every feature has a row without a number, and no contribution is off."""
    x = SimpleNamespace(spark=spark, frame=frame.withColumn("split", F.lit("test")))
    ask = lambda name: queries._SPARK[name](x)
    drops, sizes = ask("permutation_drops"), ask("trained_importance")
    assert drops.dtypes == [("feature", "string"), ("drop", "double"), ("drop_deviation", "double")]
    assert {tuple(r)[1:] for r in drops.collect()} == {(None, None)} and {r["mean_abs"] for r in sizes.collect()} == {None}
    names = [r["feature"] for r in drops.collect()]
    assert len({*names}) == len(names) == 17 and {*names} == {r["feature"] for r in sizes.collect()}
    assert tuple(ask("contributions_add_up").first()) == (1500, 0)


def test_drops_without_rows(frame):
    """A model and no row to test it on."""
    model = fit_together(frame, "creation", [Spec("all", F.lit(1), 0.3)])
    score = lambda df: scored_together(df, model).withColumn("score", F.col("scores")[0])
    assert [tuple(r) for r in explain.permutation_drops(frame.filter("is_late is null"), score, "issue_key", ["link_count"]).collect()] == [("link_count", None, None)]


def test_only_what_is_scored_is_dealt(spark, frame, monkeypatch):
    """Other columns of a row do not go through Python with each of its copies."""
    seen = []
    monkeypatch.setattr(queries, "P", replace(queries.P, train_cutoff=datetime(2017, 1, 1)))
    monkeypatch.setattr(together, "scored_together", lambda df, models: (seen.append(set(df.columns)), scored_together(df, models))[1])
    found = queries._SPARK["permutation_drops"](SimpleNamespace(spark=spark, frame=frame.withColumns({"split": F.when(F.col("created") >= "2017-01-01", "test"), "more": F.lit("x")}))).collect()
    assert len(found) == 17 and all(r["drop"] is not None for r in found)
    assert len(seen) == 2 and all(s - {"_feature", "_repeat"} == {"issue_key", "is_late", *queries._features("creation")} for s in seen)
