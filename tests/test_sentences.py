from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from tempolith.plans.model_frames import feature_columns
from tempolith.plans.sentences import TEXTS, WORDING, describe


def test_every_feature_has_a_wording():
    assert set(WORDING) == {c for point in ("creation", "day7") for columns in feature_columns(point).values() for c in columns}


def said(spark, feature, values, point="creation", **more):
    rows = spark.createDataFrame([(i, v, point) for i, v in enumerate(values)], f"i int, {feature} {'string' if feature in TEXTS else 'double'}, point string")
    return [r["x"] for r in rows.select("i", describe(feature, **more).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("feature", "cases"),
    [
        ("assignee_open", {None: "Not assigned when filed", 3.0: "Assigned when filed (assignee has 3 other open tickets)"}),
        ("reporter_prior_tickets", {None: "Reporter unknown", float("nan"): "Reporter unknown", 0.0: "First ticket this reporter has filed", 1.0: "Reporter has filed 1 earlier ticket", 2.0: "Reporter has filed 2 earlier tickets"}),
        ("link_count", {None: "Link count not available", 0.0: "No linked tickets", 1.0: "1 linked ticket", 8.0: "8 linked tickets"}),
        ("commenters_by_day7", {1.0: "1 person had commented by day 7", 2.0: "2 people had commented by day 7"}),
        ("priority_rank", {None: "No priority set", 1.0: "Priority is in the top part of its project's scale", 0.0: "Priority is in the bottom part of its project's scale", 0.5: "Priority is in the middle part of its project's scale"}),
        ("peer_n", {None: "No similar resolved tickets to compare with", 29.0: "Only 29 similar tickets resolved so far to compare with", 30.0: "Compared with the last 30 similar tickets"}),
        ("peer_late_rate", {0.26: "26% of similar recent tickets ran late", 0.0: "0% of similar recent tickets ran late"}),
        ("has_assignee", {0.0: "Still unassigned on day 7", 1.0: "Assigned by day 7"}),
        ("issue_type", {None: "Issue type not available", "Bug {n}": "Issue type: Bug {n}"}),
    ],
)
def test_sentences(spark, feature, cases):
    assert said(spark, feature, list(cases)) == list(cases.values())


def test_sentences_that_compare(spark):
    assert said(spark, "title_length", [10.0, 40.0, 100.0], typical=F.lit(40.5)) == ["Short title (10 characters; typical here 40)", "Typical title (40 characters; typical here 40)", "Long title (100 characters; typical here 40)"]
    assert said(spark, "project_key", ["P"], rate=F.lit(None).cast("double"), all_rate=F.lit(0.25)) == ["P: 25% of past tickets here ran late (all projects 25%)"]
    assert said(spark, "project_key", ["{rate}"], rate=F.lit(0.5), all_rate=F.lit(0.25)) == ["{rate}: 50% of past tickets here ran late (all projects 25%)"]
    assert said(spark, "stage_at_day7", ["Building", "OTHER"]) == ["Still being worked on on day 7", "Still other on day 7"]
    assert said(spark, "assignee_open", [None], point="day7") == ["Not assigned by day 7"]
