"""Which tickets count, and why others do not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import at, days_between, seconds_between
from ..params import Params
from ..sources.relations import Relations

BASE = ["issue_key", "project_key", "issue_type", "priority", "status", "resolution", "created", "resolution_date", "assignee", "reporter"]


def in_scope(issues: DataFrame, p: Params) -> DataFrame:
    """Tickets of the chosen projects and types; a ticket without a type stays."""
    return issues.filter(F.col("project_key").isin(*p.projects) & ~F.coalesce("issue_type", F.lit("")).isin(*p.excluded_types)).select(*BASE)


def _delivered(p: Params) -> F.Column:
    return F.coalesce(F.col("resolution").isin(*p.delivered), F.lit(False)) & F.col("resolution_date").isNotNull()


def bulk_closed(base: DataFrame, changelog: DataFrame, p: Params) -> DataFrame:
    """(issue_key): delivered tickets that someone resolved together with many others of the project in one minute.

    Counted by partial aggregates and joined back, so one busy author costs no more than others; unknown authors are one.
    """
    done = changelog.filter((F.col("field") == "resolution") & F.col("to_string").isNotNull()).select("issue_key", "author", F.date_trunc("minute", "created").alias("minute"))
    rows = done.join(base.filter(_delivered(p)).select("issue_key", "project_key"), "issue_key")
    many = rows.groupBy("project_key", "author", "minute").agg(F.count("*").alias("n")).filter(F.col("n") >= p.bulk_min)
    same = (F.col("r.project_key") == F.col("m.project_key")) & F.col("r.author").eqNullSafe(F.col("m.author")) & F.col("r.minute").eqNullSafe(F.col("m.minute"))
    return rows.alias("r").join(many.alias("m"), same, "left_semi").select("issue_key").distinct()


def tickets(rel: Relations, p: Params) -> DataFrame:
    """One row for each ticket in scope, with flags and the reason it is excluded, if any."""
    base = in_scope(rel.issues, p)
    bulk = bulk_closed(base, rel.changelog, p).withColumn("_bulk", F.lit(True))
    created, resolved = F.col("created"), F.col("resolution_date")
    flagged = base.join(bulk, "issue_key", "left").select(
        *BASE,
        resolved.isNotNull().alias("is_resolved"),
        _delivered(p).alias("is_delivered"),
        days_between(created, resolved).alias("lead_days"),
        (created < at(p.min_created)).alias("bad_created"),
        (resolved < created).alias("negative_lead"),
        (_delivered(p) & (seconds_between(created, resolved) < p.too_fast_hours * 3600)).alias("too_fast"),
        F.coalesce("_bulk", F.lit(False)).alias("bulk_closed"),
    )
    # the first that applies
    reason = F.coalesce(*(F.when(F.col(c), c) for c in ("bad_created", "negative_lead", "bulk_closed", "too_fast")))
    return flagged.withColumn("exclusion_reason", reason)
