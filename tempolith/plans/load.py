"""Typed tables from raw ones. A ticket that was written twice is kept once, with its child rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import naive_utc
from ..operators.ordered import first_by
from ..sources.relations import Relations


def dedupe_issues(raw: DataFrame) -> DataFrame:
    """The latest copy of each key by its text of ``updated``; of equal ones the first by all other columns."""
    others = [F.to_json(F.struct(*(c for c in raw.columns if c != "issue_key")))]
    return first_by(raw, ["issue_key"], [F.col("updated").desc_nulls_last(), *others])


def collapse_children(rows: DataFrame, kept: DataFrame, doubled: DataFrame) -> DataFrame:
    """Rows of the kept tickets; identical rows are collapsed, but only of doubled tickets.

    Keys that are null belong to no ticket. Both sides are joined by key, and only doubled tickets' rows are compared.
    """
    own = rows.join(kept.select("issue_key").distinct(), "issue_key", "left_semi")
    twice = doubled.select("issue_key").filter("issue_key is not null")
    return own.join(twice, "issue_key", "left_anti").unionByName(own.join(twice, "issue_key", "left_semi").distinct())


def load(raw: dict[str, DataFrame], keep_projects: tuple[str, ...] | None = None) -> Relations:
    """Typed relations. Issues of all projects stay; the others only for ``keep_projects``, if given."""
    issues = raw["issues"]
    kept = issues.filter(F.col("project_key").isin(*keep_projects)) if keep_projects else issues
    doubled = issues.groupBy("issue_key").agg(F.count("*").alias("n")).filter("n > 1")
    typed = dedupe_issues(issues)
    typed = typed.withColumns({c: naive_utc(F.col(c)) for c in ("created", "updated", "resolution_date")} | {"due_date": F.to_date(F.try_to_timestamp("due_date", F.lit("yyyy-MM-dd")))})
    changelog = collapse_children(raw["changelog"], kept, doubled).withColumn("created", naive_utc(F.col("created")))
    comments = collapse_children(raw["comments"], kept, doubled).withColumns({c: naive_utc(F.col(c)) for c in ("created", "updated")})
    stats = raw["issue_text"].join(kept.select("issue_key").distinct(), "issue_key", "left_semi").groupBy("issue_key").agg(F.max(F.length("summary")).alias("summary_length"), F.max(F.length("description")).alias("description_length"))
    return Relations(typed, changelog, comments, stats)
