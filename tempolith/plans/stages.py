"""Status history as stages: intervals, time in each stage, flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import at, days_between, key_of
from ..operators.spans import build_spans
from ..params import Params
from ..sources.relations import Relations

UNMAPPED = "Unmapped"


def status_intervals(tickets: DataFrame, rel: Relations, stage_map: DataFrame, p: Params) -> DataFrame:
    """Spans of one status each, up to the final resolution or the snapshot, with their stage; empty spans are left out.

    ``ord`` numbers all spans of a ticket, ``prev_stage`` is the stage of the span before among those that are not empty.
    """
    kept = tickets.filter("exclusion_reason is null")
    initial = kept.select("issue_key", "status", F.col("created").alias("start_at"), F.coalesce("resolution_date", at(p.snapshot)).alias("_end"))
    # a first change from nothing leaves the current status
    spans = build_spans(initial, rel.changelog.filter("field = 'status'"), "issue_key", "status", "from_string", "to_string", at(p.snapshot), carry=("_end",), null_first=False)
    cut = spans.withColumn("end_at", F.least("end_at", "_end")).filter("end_at > start_at")
    # the map is a configuration file of tens of rows
    staged = cut.join(F.broadcast(stage_map), key_of(F.col("status")) == F.col("status_key"), "left").withColumn("stage", F.coalesce("stage", F.lit(UNMAPPED)))
    # the order of ``ord``, in which the spans lie already
    before = F.lag("stage").over(Window.partitionBy("issue_key").orderBy("start_at", "seq"))
    return staged.select("issue_key", "ord", "status", "stage", "start_at", "end_at", days_between(F.col("start_at"), F.col("end_at")).alias("days"), before.alias("prev_stage"))


def ticket_stages(tickets: DataFrame, intervals: DataFrame) -> DataFrame:
    """Days in each stage, first entries, review rounds and reopenings of every ticket that is not excluded."""
    stage = F.col("stage")
    days = lambda s: F.coalesce(F.sum(F.when(stage == s, F.col("days"))), F.lit(0.0))
    per = intervals.groupBy("issue_key").agg(
        days("Waiting").alias("waiting_days"),
        days("Building").alias("building_days"),
        days("In review").alias("in_review_days"),
        days("Done").alias("resolved_gap_days"),
        F.min(F.when(stage.isin("Building", "In review"), F.col("start_at"))).alias("first_active_at"),
        F.min(F.when(stage == "In review", F.col("start_at"))).alias("first_review_at"),
        F.count_if((stage == "Waiting") & (F.col("prev_stage") == "In review")).alias("review_rounds"),
        F.count_if(F.lower("status") == "reopened").alias("reopen_count"),
    )
    zero = {c: 0.0 for c in ("waiting_days", "building_days", "in_review_days", "resolved_gap_days")} | {"review_rounds": 0, "reopen_count": 0}
    return tickets.filter("exclusion_reason is null").select("issue_key").join(per, "issue_key", "left").fillna(zero)


def ticket_flow(tickets: DataFrame, stages: DataFrame) -> DataFrame:
    """Stage times beside cycle time and the wait for the first review; null unless resolved after entering the stage."""
    rows = tickets.select("issue_key", "project_key", "issue_type", "is_delivered", "lead_days", "is_resolved", "created", "resolution_date", "priority", "assignee").join(stages, "issue_key")
    entered = lambda c: F.col("is_resolved") & (F.col(c) < F.col("resolution_date"))
    cycle = F.when(entered("first_active_at"), days_between(F.col("first_active_at"), F.col("resolution_date")))
    wait = F.when(entered("first_review_at"), days_between(F.col("created"), F.col("first_review_at")))
    return rows.withColumn("cycle_days", cycle).withColumn("wait_to_first_review_days", wait).drop("is_resolved", "created", "resolution_date")
