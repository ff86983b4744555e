from __future__ import annotations

from datetime import datetime
from itertools import combinations
from math import comb

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from tempolith.plans import explain, models, trees

from .test_models import frame  # noqa: F401


@pytest.fixture(scope="module")
def boosted(frame):  # noqa: F811
    return models.fit("boosting", "creation", frame, {"step": 0.3, "depth": 3, "rounds": 4})


def test_shapley_values_equal_their_definition(frame, boosted):  # noqa: F811
    last, origins = boosted.pipeline.stages[-1], boosted.origins()
    used = sorted({c.feature for leaf in trees.leaves(last) for c in leaf.conditions})
    roots = [(t._call_java("rootNode"), w) for t, w in zip(last.trees, last.treeWeights, strict=True)]

    def value(node, x, known):  # a node's expectation when only the known features are
        if node.numDescendants() == 0:
            return node.prediction()
        split, children = node.split(), (node.leftChild(), node.rightChild())
        if split.featureIndex() in known:
            v = x[split.featureIndex()]
            left = v <= split.threshold() if split.getClass().getSimpleName() == "ContinuousSplit" else v in list(split.leftCategories())
            return value(children[0 if left else 1], x, known)
        n = [c.impurityStats().count() for c in children]
        return sum(k * value(c, x, known) for k, c in zip(n, children, strict=True)) / sum(n)

    game = lambda x, known: sum(2 * w * value(r, x, set(known)) for r, w in roots)
    rows = boosted.pipeline.transform(boosted.numbers.scaled(frame.filter("issue_key in (0, 3, 11)"))).select("issue_key", vector_to_array("features").alias("x")).collect()
    assert 2 <= len(used) <= 8
    got = {(r["issue_key"], r["feature"]): r["contribution"] for r in boosted.contributions(frame, ["issue_key"]).collect()}
    for r in rows:
        want = dict.fromkeys(origins, 0.0)
        of = {k: game(r["x"], k) for size in range(len(used) + 1) for k in combinations(used, size)}
        for f in used:
            for known, v in of.items():
                if f not in known:
                    want[origins[f]] += (of[tuple(sorted((*known, f)))] - v) / (len(used) * comb(len(used) - 1, len(known)))
        assert {f: got[r["issue_key"], f] for f in want} == pytest.approx(want, abs=1e-9)


def test_parts_add_up_to_the_score(frame, boosted):  # noqa: F811
    parts = {r["issue_key"]: r["s"] for r in boosted.contributions(frame, ["issue_key"]).groupBy("issue_key").agg(F.sum("contribution").alias("s")).collect()}
    scores = boosted.score(frame).select("issue_key", "score").collect()
    assert len(scores) == len(parts) == 1600
    for r in scores:
        assert np.log(r["score"] / (1 - r["score"])) == pytest.approx(parts[r["issue_key"]] + boosted.base(), abs=1e-6)
    assert boosted.contributions(frame.limit(0), ["issue_key"]).count() == 0


def test_parts_that_do_not_add_up_are_an_error(frame, boosted):  # noqa: F811
    scored = boosted.pipeline.transform(boosted.numbers.scaled(frame)).select("issue_key", vector_to_array("features").alias("_v"), F.lit(9.0).alias("_raw"))
    with pytest.raises(Exception, match="do not add up"):
        trees.contributions(scored, ["issue_key"], trees.leaves(boosted.pipeline.stages[-1]), boosted.origins()).collect()


def test_importance_finds_the_cause(frame, boosted):  # noqa: F811
    assert boosted.pipeline and max(explain.importance(boosted, frame, ["issue_key"]).collect(), key=lambda r: r["mean_abs"])["feature"] == "link_count"
    dealt = {r["feature"]: r for r in explain.permutation_importance(boosted, frame, "issue_key", ["link_count", "project_key", "priority_rank"], repeats=2).collect()}
    assert len(dealt) == 3 and dealt["link_count"]["drop"] > 0.05 > abs(dealt["project_key"]["drop"])


def test_dealing_anew_keeps_every_value(frame, boosted, monkeypatch):  # noqa: F811
    seen = []
    monkeypatch.setattr(models.Fitted, "score", lambda self, rows: seen.append(rows) or rows.withColumn("score", F.lit(0.5)))
    monkeypatch.setattr(explain, "BLOCK", 100)
    explain.permutation_importance(boosted, frame, "issue_key", ["link_count"], repeats=1)
    whole, dealt = (sorted(map(str, (r["link_count"] for r in rows.collect()))) for rows in seen)
    assert whole == dealt
    moved = seen[1].select("issue_key", F.col("link_count").alias("now")).join(frame.select("issue_key", "link_count"), "issue_key")
    assert moved.count() == 1600 and moved.filter(~F.col("now").eqNullSafe(F.col("link_count"))).count() > 800


def test_ablations_and_stability(frame):  # noqa: F811
    params, train, test = {"C": 0.3}, frame.filter("created < '2017-01-01'"), frame.filter("created >= '2017-01-01'")
    found = {r["name"]: r for r in explain.ablations("logistic", "creation", train, test, params, {"all": (), "no_link": ("link_count", "project_key")})}
    assert found["all"]["average_precision"] > found["no_link"]["average_precision"] and found["all"]["roc_auc"] > 0.55
    model = models.fit("logistic", "creation", train, params)
    runs = explain.stability(model, "creation", train, test, params, "issue_key", [datetime(2016, 1, 1)], replicates=1)
    assert [next(iter(r)) for r in runs] == ["resample", "known_at"]
    assert all(r["top3"][0] == "link_count" and -1 <= r["spearman"] <= 1 and 1 <= r["top3_overlap"] <= 3 for r in runs)


def test_spearman():
    assert explain.spearman([(1.0, 10.0), (2.0, 20.0), (3.0, 15.0)]) == pytest.approx(0.5)
    assert explain.spearman([(1.0, 1.0), (2.0, 1.0)]) is None
    assert explain.spearman([(1.0, 2.0), (1.0, 2.0), (3.0, 5.0)]) == pytest.approx(1.0)
