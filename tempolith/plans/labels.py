"""Late or on time: percentile thresholds of peer groups and the label of each ticket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import at, days_between
from ..operators.ordered import quantiles
from ..params import Params

LEVELS = {"project_type": ["project_key", "issue_type"], "project": ["project_key"], "type": ["issue_type"]}


def peer_thresholds(tickets: DataFrame, p: Params) -> DataFrame:
    """(level, project_key, issue_type, n, threshold_days) of delivered tickets created and resolved before the cutoff."""
    cutoff = at(p.train_cutoff)
    pool = tickets.filter(F.col("is_delivered") & F.col("exclusion_reason").isNull() & (F.col("created") < cutoff) & (F.col("resolution_date") < cutoff))
    groups = F.explode(F.array(*(F.struct(F.lit(level).alias("level"), *((F.col(c) if c in keys else F.lit(None).cast("string")).alias(c) for c in ("project_key", "issue_type"))) for level, keys in LEVELS.items())))
    rows = pool.select("lead_days", groups.alias("g")).select("g.*", "lead_days")
    found = quantiles(rows, ["level", "project_key", "issue_type"], "lead_days", {"threshold_days": p.percentile})
    return found.select("level", "project_key", "issue_type", "n", "threshold_days")


def late_labels(tickets: DataFrame, thresholds: DataFrame, p: Params) -> DataFrame:
    """The label of each ticket by its peer group's threshold; small groups fall back to the project, then to the type."""
    enough = thresholds.filter(F.col("n") >= p.min_group)
    df = tickets
    for level, keys in LEVELS.items():
        own = enough.filter(F.col("level") == level).select(*keys, F.col("threshold_days").alias(f"_{level}"))
        df = df.join(own, keys, "left")
    threshold = F.coalesce(*(F.col(f"_{level}") for level in LEVELS))
    level = F.coalesce(*(F.when(F.col(f"_{name}").isNotNull(), name) for name in LEVELS))
    df = df.withColumn("age_days", days_between(F.col("created"), F.coalesce("resolution_date", at(p.snapshot)))).withColumn("threshold_level", level).withColumn("threshold_days", threshold)
    status = (
        F.when(F.col("exclusion_reason").isNotNull(), F.concat(F.lit("excluded:"), F.col("exclusion_reason")))
        .when(F.col("is_resolved") & ~F.col("is_delivered"), "not_delivered")
        .when(F.col("threshold_days").isNull(), "no_threshold")
        .when(F.col("is_delivered"), "labelled")
        .when(F.col("age_days") > F.col("threshold_days"), "open_known_late")
        .otherwise("open_unlabelled")
    )
    df = df.withColumn("label_status", status)
    delivered_late = F.when(F.col("label_status") == "labelled", F.col("lead_days") > F.col("threshold_days"))
    created, cutoff = F.col("created"), at(p.train_cutoff)
    split = F.when(created < cutoff, "train").when(created < at(p.test_start), "gap").when(created < at(p.test_end), "test").otherwise("after")
    known = (F.col("resolution_date") < cutoff) | (days_between(created, cutoff) > F.col("threshold_days"))
    return df.select(
        "issue_key", "project_key", "issue_type", "created", "resolution_date", "is_resolved", "is_delivered", "lead_days", "age_days", "threshold_level", "threshold_days", "label_status",
        F.when(F.col("label_status") == "open_known_late", True).otherwise(delivered_late).alias("is_late"),
        delivered_late.alias("is_late_delivered_only"),
        split.alias("split"),
        ((created < cutoff) & F.col("label_status").isin("labelled", "open_known_late") & known).alias("train_eligible"),
    )
