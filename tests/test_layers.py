"""Hand-made tickets through all layers, with the labels, stages and features that they must get."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tempolith.operators.spans import build_spans
from tempolith.params import Params
from tempolith.plans import checks, features, labels, model_frames, scope, stages
from tempolith.queries import Layers
from tempolith.sources import surrogate
from tempolith.sources.relations import Relations

DAY = timedelta(days=1)
P = Params(
    projects=("P1",), excluded_types=("Epic", "Sub-task"), delivered=("Fixed", "Done"), min_created=datetime(2001, 1, 1), snapshot=datetime(2021, 6, 1), train_cutoff=datetime(2020, 1, 1), test_start=datetime(2020, 2, 1), test_end=datetime(2021, 1, 1),
    too_fast_hours=1, bulk_min=10, min_group=30, review_projects=("P1",), slice_seconds=20 * 86_400,
)
STAGES = [("open", "Waiting"), ("reopened", "Waiting"), ("in progress", "Building"), ("patch available", "In review"), ("resolved", "Done")]
ISSUE = "issue_key string, project_key string, issue_type string, status string, resolution string, created timestamp_ntz, resolution_date timestamp_ntz, priority string, assignee string, reporter string, components array<string>, link_count int, comment_count int"
CHANGE = "issue_key string, history_id string, created timestamp_ntz, author string, field string, from_value string, from_string string, to_value string, to_string string"


@pytest.fixture(scope="module")
def world(spark):
    start = datetime(2019, 1, 1)
    tickets, changes = [], []

    def add(key, created, resolved, resolution="Fixed", kind="Bug", project="P1", events=(), status="Resolved"):
        tickets.append((key, project, kind, status if resolved else "Open", resolution if resolved else None, created, resolved, "Major", "ann", "rob", ["c"], 1, 0))
        for n, (t, old, new) in enumerate(events or ([(resolved, "Open", status)] if resolved else [])):
            changes.append((key, str(n + 1), t, "x", "status", None, old, None, new))

    for i in range(40):
        add(f"T{i}", start + i * DAY, start + i * DAY + (i + 1) * DAY)
    march = datetime(2020, 3, 1)
    add("A", march, march + 10 * DAY)
    add("B", march, march + 31 * DAY)
    add("C", march, march + 30 * DAY)
    add("D", march, march + 4 * DAY, "Duplicate")
    add("E", march, None)
    add("F", datetime(2021, 5, 25), None)
    add("G", march, march + timedelta(minutes=30))
    add("H", datetime(1999, 1, 1), datetime(1999, 3, 1))
    add("I", march, march + 9 * DAY, kind="Epic")
    add("J", march, march + 45 * DAY, kind="Task")
    add("K", march, march + 50 * DAY, events=[(march + 5 * DAY, "Open", "Resolved"), (march + 9 * DAY, "Resolved", "Reopened"), (march + 50 * DAY, "Reopened", "Resolved")])
    add("L", datetime(2019, 12, 1), datetime(2020, 6, 1))
    add("M", datetime(2019, 12, 20), march)
    add("N", march, march + 9 * DAY, project="P2")
    add("O", march, march + 10 * DAY, events=[(march + 2 * DAY, "Open", "Patch Available"), (march + 10 * DAY, "Patch Available", "Resolved")])
    add("R", march, march + 20 * DAY, events=[(march + 2 * DAY, "Open", "Patch Available"), (march + 5 * DAY, "Patch Available", "Open"), (march + 7 * DAY, "Open", "In Progress"), (march + 11 * DAY, "In Progress", "Patch Available"), (march + 20 * DAY, "Patch Available", "Resolved")])
    add("Q", march, march + 10 * DAY, events=[(march + 2 * DAY, "Open", "Strange"), (march + 10 * DAY, "Strange", "Resolved")])
    add("S", march, march + 5 * DAY)
    add("U", datetime(2021, 5, 30), None)
    changes += [("A", "7", march + 3 * DAY, "x", "summary", None, "a title that was long", None, "short"), ("A", "8", march + 8 * DAY, "x", "priority", None, "Trivial", None, "Major"), ("A", "9", march + 9 * DAY, "x", "Link", None, None, None, "l")]
    keys = [(t[0], 20, 100) for t in tickets]
    rel = Relations(spark.createDataFrame(tickets, ISSUE), spark.createDataFrame(changes, CHANGE), spark.createDataFrame([("A", march + DAY, "bob")], "issue_key string, created timestamp_ntz, author string"), spark.createDataFrame(keys, "issue_key string, summary_length int, description_length int"))
    rel = Relations(rel.issues.cache(), rel.changelog.cache(), rel.comments, rel.text_stats)
    found = scope.tickets(rel, P).cache()
    thresholds = labels.peer_thresholds(found, P).cache()
    marks = labels.late_labels(found, thresholds, P).cache()
    spans = stages.status_intervals(found, rel, spark.createDataFrame(STAGES, "status_key string, stage string"), P).cache()
    pts = features.points(found, marks, P).cache()
    changed, wide = features.rewindable(rel.changelog, pts), features.scope_issues(rel.issues, P)
    held = features.assignee_spans(rel.changelog, wide, P).cache()
    parts = features.Parts(
        pts, features.first_after(pts, changed), features.net_changes(pts, changed), held, features.assignee_load(held, wide, P), features.project_load(wide, P), features.reporter_prior(rel.issues, P),
        features.trailing_stats(marks, ["project_key", "issue_type"], P), features.trailing_stats(marks, ["project_key"], P), features.activity_until(pts, found, rel.changelog, rel.comments), features.state_at(pts, spans),
    )
    ranks = spark.createDataFrame([("major", 0.5), ("trivial", 0.0)], "priority_key string, rank double")
    rows = {(r["issue_key"], r["point"]): r for r in features.features(rel, parts, ranks, P).collect()}
    return {
        "thresholds": thresholds.collect(), "labels": {r["issue_key"]: r for r in marks.collect()}, "tickets": found, "spans": spans, "features": rows,
        "stages": {r["issue_key"]: r for r in stages.ticket_flow(found, stages.ticket_stages(found, spans)).collect()},
    }


def test_thresholds_come_from_the_training_pool(world):
    (bugs,) = [r for r in world["thresholds"] if r["level"] == "project_type"]
    assert (bugs["n"], bugs["threshold_days"]) == (40, 30.25)


@pytest.mark.parametrize(("key", "status", "late"), [("A", "labelled", False), ("B", "labelled", True), ("C", "labelled", False), ("D", "not_delivered", None), ("E", "open_known_late", True), ("F", "open_unlabelled", None), ("G", "excluded:too_fast", None), ("H", "excluded:bad_created", None), ("K", "labelled", True)])
def test_labels(world, key, status, late):
    assert (world["labels"][key]["label_status"], world["labels"][key]["is_late"]) == (status, late)


def test_scope_fallback_and_split(world):
    found = world["labels"]
    assert not {"I", "N"} & set(found)
    assert (found["J"]["threshold_level"], found["J"]["threshold_days"]) == ("project", 30.25)
    assert (found["T0"]["split"], found["A"]["split"], found["F"]["split"]) == ("train", "test", "after")
    assert found["L"]["train_eligible"] is True and found["M"]["train_eligible"] is False and found["E"]["is_late_delivered_only"] is None


def test_stages(world):
    o, r, k = (world["stages"][x] for x in "ORK")
    assert (o["waiting_days"], o["in_review_days"], o["cycle_days"], o["wait_to_first_review_days"]) == (2, 8, 8, 2)
    assert (r["review_rounds"], r["in_review_days"], r["building_days"], r["waiting_days"]) == (1, 12, 4, 4)
    assert (k["reopen_count"], k["resolved_gap_days"]) == (1, 4)
    assert [x["status"] for x in checks.unmapped_statuses(world["spans"]).collect()] == ["Strange"]


def test_spans_cover_time_without_overlap(world):
    ends = {r["issue_key"]: r["resolution_date"] or P.snapshot for r in world["tickets"].collect()}
    by_key = {}
    for r in world["spans"].orderBy("issue_key", "start_at").collect():
        by_key.setdefault(r["issue_key"], []).append((r["start_at"], r["end_at"]))
    for key, spans in by_key.items():
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[-1][1] == ends[key]


def test_points(world):
    points = lambda k: {p for key, p in world["features"] if key == k}
    assert points("A") == {"creation", "day7"} == points("F")
    assert points("K") == points("S") == points("U") == {"creation"}


def test_values_as_they_stood(world):
    a, b = world["features"]["A", "creation"], world["features"]["A", "day7"]
    assert (a["title_length"], b["title_length"]) == (len("a title that was long"), 20)
    assert (a["priority_rank"], b["priority_rank"], a["link_count"], b["component_count"]) == (0.0, 0.0, 0, 1)
    assert (b["events_by_day7"], b["comments_by_day7"], b["commenters_by_day7"], b["days_since_activity_day7"]) == (1, 1, 1, 4.0)
    assert (a["stage_at_day7"], b["stage_at_day7"], a["workflow_family"], a["has_assignee"]) == (None, "Waiting", "jira_review", True)
    assert a["peer_n"] == 40 and a["peer_median_lead_days"] == 20.5


def test_no_leak(world, spark):
    columns = list(next(iter(world["features"].values())).asDict())
    frame = spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    assert model_frames.leaks(frame) == {"never": set(), "unknown": set()}
    assert not model_frames.allowed_columns() & model_frames.NEVER
    assert model_frames.leaks(frame.withColumn("is_late", F.lit(1)))["never"] == {"is_late"}


def test_tickets_are_worked_out_once(spark):
    """Issues are written once: what reads them does not go over the lines of all orders again."""
    with Layers(spark, "/root/testdata/sf0.001") as layers:
        assert not any("lineitem" in f for f in layers.rel.issues.inputFiles())
        assert any("lineitem" in f for f in layers.rel.comments.inputFiles())


def test_rows_by_ticket_stay_where_they_are(spark):
    """A ticket's points come as one map, so a join with them is by the ticket alone; a point without a row has none."""
    rows = spark.createDataFrame([("A", "creation", 1), ("A", "day7", 2), ("B", "day7", None)], "issue_key string, point string, n int")
    found = {r["issue_key"]: {k: v["n"] for k, v in r["m"].items()} for r in features.by_ticket(rows, "m").collect()}
    assert found == {"A": {"creation": 1, "day7": 2}, "B": {"day7": None}}


def test_lines_of_an_order_are_shuffled_once(spark):
    """Counting distinct suppliers of an order takes one exchange of its lines."""
    lines = surrogate.issues(spark, "/root/testdata/sf0.001").select("issue_key", "link_count")
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1 and "l_suppkey" not in "".join(x for x in plan.split("\n") if "Exchange hashpartitioning(l_orderkey" in x)


def _operators(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_distinct_suppliers_take_no_maps(spark):
    """An order's lines go through one sort and windows of an order, not through maps of all rows of a task."""
    plan = _operators(surrogate.issues(spark, "/root/testdata/sf0.001").select("issue_key", "link_count", "comment_count"))
    assert "HashAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_activity_is_shuffled_once(spark):
    """Points, tickets, changes and comments meet in one exchange; odd rows count as they do in SQL."""
    t = lambda day: datetime(2020, 1, day)
    pts = spark.createDataFrame([("A", "creation", t(1)), ("A", "day7", t(8)), ("B", "day7", t(9)), ("gone", "day7", t(9))], "issue_key string, point string, t_at timestamp_ntz")
    found = spark.createDataFrame([("A", t(1)), ("B", t(2)), ("C", t(1)), (None, t(1))], "issue_key string, created timestamp_ntz")
    changes = spark.createDataFrame([("A", "1", t(2)), ("A", "1", t(3)), ("A", "2", t(9)), ("A", "3", None), ("A", "3", t(4)), ("A", None, t(5)), ("C", "1", t(2)), ("gone", "1", t(2)), (None, "1", t(2))], "issue_key string, history_id string, created timestamp_ntz")
    comments = spark.createDataFrame([("A", "x", t(8)), ("A", "x", t(7)), ("A", None, t(6)), ("A", "y", t(20)), (None, "x", t(2))], "issue_key string, author string, created timestamp_ntz")
    rows = features.activity_until(pts, found, changes, comments)
    plan = _operators(rows)
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert {r["issue_key"]: tuple(r)[1:] for r in rows.collect()} == {"A": (2, 3, 1, 0.0), "B": (0, 0, 0, 7.0)}


def test_spans_are_shuffled_once(spark):
    """Stages of tickets take one exchange of tickets and changes together, and none of the intervals; the odd first states are kept."""
    with Layers(spark, "/root/testdata/sf0.001") as layers:
        plan = _operators(layers._spans())
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
        assert layers.ticket_stages.count() > 0 and "intervals" not in vars(layers)
    t = lambda day: datetime(2020, 1, day)
    initial = spark.createDataFrame([("A", "now", t(3), 1), ("B", "now", t(1), 2)], "k string, v string, start_at timestamp_ntz, c int")
    changes = spark.createDataFrame([("A", t(1), "2", None, "x"), ("A", t(1), "10", "x", "y"), ("C", t(1), "1", "x", "y"), (None, t(1), "1", "x", "y")], "k string, created timestamp_ntz, history_id string, old string, new string")
    spans = lambda **how: sorted(tuple(r) for r in build_spans(initial, changes, "k", "v", "old", "new", F.lit(t(9)).cast("timestamp_ntz"), carry=("c",), **how).fillna("none", "v").collect())
    b = ("B", "now", t(1), t(9), 1, 0, 2)
    assert spans(not_before=True) == [("A", "none", t(3), t(3), 1, 0, 1), ("A", "x", t(3), t(3), 2, 1, 1), ("A", "y", t(3), t(9), 3, 2, 1), b]
    assert spans(null_first=False) == [("A", "now", t(3), t(9), 3, 0, 1), ("A", "x", t(1), t(1), 1, 1, 1), ("A", "y", t(1), t(3), 2, 2, 1), b]


def test_analysis_reads_tickets_once(spark):
    """Priority and assignee come along with a ticket's stages: labels, tickets, stages and issues are joined by three joins."""
    with Layers(spark, "/root/testdata/sf0.001") as layers:
        assert {"priority", "assignee"} <= set(layers.flow.columns)
        plan = layers.base._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join Inner") == 3
