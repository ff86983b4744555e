"""Where delivery time goes: tables over delivered tickets, and the reports made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import capped_count, percent, rounded, yes_no
from ..operators.ordered import quantiles
from ..params import Params


def analysis_base(labels: DataFrame, flow: DataFrame, issues: DataFrame) -> DataFrame:
    """One row for each labelled ticket; late means late among delivered ones."""
    entered = lambda c: F.col(c).isNotNull() & (F.col(c) < F.col("resolution_date"))
    rows = (
        labels.filter("label_status = 'labelled'")
        .join(flow.drop("project_key", "issue_type", "is_delivered", "lead_days"), "issue_key")
        .join(issues.select("issue_key", "components", "link_count", "comment_count"), "issue_key")
    )
    return rows.select(
        "issue_key", "project_key", "issue_type", "created", "resolution_date", "lead_days", F.col("is_late_delivered_only").alias("is_late"), "split", F.year("created").alias("created_year"),
        "priority", F.col("assignee").isNotNull().alias("has_assignee"), "waiting_days", "building_days", "in_review_days", "resolved_gap_days", "cycle_days", "wait_to_first_review_days", "review_rounds", "reopen_count",
        F.coalesce(entered("first_review_at"), F.lit(False)).alias("entered_review"), F.coalesce(entered("first_active_at"), F.lit(False)).alias("entered_active"),
        F.coalesce(F.array_size("components"), F.lit(0)).alias("component_count"), F.coalesce("link_count", F.lit(0)).alias("link_count"), "comment_count",
    )


def _with_quantiles(base: DataFrame, groups: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], digits: int) -> DataFrame:
    """``groups`` beside rounded exact quantiles: name -> (column, share). No task holds a group's values."""
    for column in dict.fromkeys(c for c, _ in wanted.values()):
        shares = {name: share for name, (c, share) in wanted.items() if c == column}
        found = quantiles(base, keys, column, shares).select(*keys, *(rounded(F.col(n), digits).alias(n) for n in shares))
        groups = groups.join(found, keys, "left")
    return groups


def lead_time_profile(base: DataFrame) -> DataFrame:
    keys = ["project_key", "issue_type"]
    groups = base.groupBy(*keys).agg(F.count("*").alias("tickets"), percent(F.col("is_late")).alias("late_pct"))
    wanted = {"median_days": ("lead_days", 0.5), "p75_days": ("lead_days", 0.75), "p90_days": ("lead_days", 0.9)}
    return _with_quantiles(base, groups, keys, wanted, 1).select(*keys, "tickets", *wanted, "late_pct")


def stage_share(base: DataFrame) -> DataFrame:
    """Shares of the summed lead time, so long tickets weigh more."""
    shares = {"waiting": "waiting_pct", "building": "building_pct", "in_review": "in_review_pct", "resolved_gap": "resolved_gap_pct"}
    return base.groupBy("project_key").agg(F.count("*").alias("tickets"), *(rounded(F.try_divide(100 * F.sum(f"{c}_days"), F.sum("lead_days")), 1).alias(n) for c, n in shares.items()))


def review_flow(base: DataFrame) -> DataFrame:
    groups = base.groupBy("project_key").agg(
        F.count("*").alias("tickets"),
        percent(F.col("entered_active")).alias("entered_active_pct"),
        percent(F.col("entered_review")).alias("entered_review_pct"),
        percent(F.col("review_rounds") > 0).alias("any_rework_pct"),
        rounded(F.avg(F.when(F.col("entered_review"), F.col("review_rounds"))), 2).alias("mean_rounds_when_reviewed"),
        percent(F.col("reopen_count") > 0).alias("reopened_pct"),
    )
    wait, cycle = "wait_to_first_review_days", "cycle_days"
    return _with_quantiles(base, groups, ["project_key"], {"median_wait_to_review_days": (wait, 0.5), "p75_wait_to_review_days": (wait, 0.75), "median_cycle_days": (cycle, 0.5)}, 2)


def factor_profile(base: DataFrame, p: Params) -> DataFrame:
    """Late rate by the levels of several factors, in one pass: each row counts once for each factor."""
    factors = {
        "issue_type": F.col("issue_type"),
        "has_assignee_at_snapshot": yes_no(F.col("has_assignee")),
        "component_count_at_snapshot": capped_count(F.col("component_count")),
        "link_count_at_snapshot": capped_count(F.col("link_count")),
        "entered_review": yes_no(F.col("entered_review")),
        "review_rounds (known late)": capped_count(F.col("review_rounds")),
    }
    pairs = F.explode(F.array(*(F.struct(F.lit(name).alias("factor"), level.alias("level")) for name, level in factors.items())))
    found = base.select("is_late", pairs.alias("f")).groupBy("f.factor", "f.level").agg(F.count("*").alias("tickets"), percent(F.col("is_late")).alias("late_pct"))
    return found.filter((F.col("factor") != "issue_type") | (F.col("tickets") >= p.factor_min))


def trend(base: DataFrame) -> DataFrame:
    keys = ["project_key", "created_year"]
    groups = base.groupBy(*keys).agg(F.count("*").alias("tickets"), percent(F.col("is_late")).alias("late_pct"))
    return _with_quantiles(base, groups, keys, {"median_days": ("lead_days", 0.5)}, 1)


def priority_profile(base: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(place, priority, n, late_pct) of some priorities, with their place in a fixed order."""
    rows = base.filter(F.col("priority").isin(*order)).groupBy("priority").agg(F.count("*").alias("n"), percent(F.col("is_late")).alias("late_pct"))
    return rows.withColumn("place", F.array_position(F.array(*map(F.lit, order)), F.col("priority")).cast("int")).select("place", "priority", "n", "late_pct")


def weighted_rollup(profile: DataFrame) -> DataFrame:
    """Ticket-weighted means of the types' medians, percentiles and rates; not the project's own medians."""
    mean = lambda c: rounded(F.sum(F.col("tickets") * F.col(c)) / F.sum("tickets"), 1).alias(f"weighted_{c}")
    return profile.groupBy("project_key").agg(F.sum("tickets").alias("tickets"), mean("median_days"), mean("p75_days"), mean("late_pct"))


def late_trend(labels: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Late rates by year of creation, with and without open tickets known to be late."""
    rows = labels.filter(F.col("label_status").isin("labelled", "open_known_late") & F.year("created").between(first_year, last_year))
    return rows.groupBy(F.year("created").alias("year")).agg(F.count("*").alias("tickets"), percent(F.col("is_late")).alias("all_labelled"), percent(F.col("is_late_delivered_only")).alias("delivered_only"))


def late_rate_by_split(labels: DataFrame) -> DataFrame:
    rows = labels.filter((F.col("split") != "train") | F.col("train_eligible"))
    return rows.groupBy("split").agg(F.count("is_late").alias("n_all"), percent(F.col("is_late")).alias("late_pct_all"), F.count("is_late_delivered_only").alias("n_delivered"), percent(F.col("is_late_delivered_only")).alias("late_pct_delivered"))


def counts_by(df: DataFrame, column: str, name: str, null: str | None = None) -> DataFrame:
    """How often each value occurs; with ``null``, under that name where it is null."""
    key = F.coalesce(F.col(column), F.lit(null)) if null else F.col(column)
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))


def project_summary(labels: DataFrame, thresholds: DataFrame) -> DataFrame:
    rates = labels.filter("label_status = 'labelled'").groupBy("project_key").agg(F.count("*").alias("n"), percent(F.col("is_late")).alias("late_pct"))
    own = thresholds.filter("level = 'project'").select("project_key", rounded(F.col("threshold_days"), 1).alias("threshold_days"))
    return rates.join(own, "project_key", "left").select("project_key", "n", "threshold_days", "late_pct")


def late_by_assigned(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Late rate of tickets with and without an assignee at their creation."""
    rows = features.filter("point = 'creation'").join(labels.filter("is_late is not null").select("issue_key", "is_late"), "issue_key")
    return rows.groupBy("has_assignee").agg(F.count("*").alias("n"), percent(F.col("is_late")).alias("late_pct"))


def workload_buckets(features: DataFrame, labels: DataFrame, edges: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """Late rate by how many other tickets the assignee has open, in left-closed buckets."""
    rows = features.filter("point = 'creation' and assignee_open is not null").join(labels.filter("is_late is not null").select("issue_key", "is_late"), "issue_key")
    bucket = F.lit(0)
    for e in edges:
        bucket = bucket + (F.col("assignee_open") >= e).cast("int")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("assignee_open").alias("least"), F.max("assignee_open").alias("most"), percent(F.col("is_late")).alias("late_pct"))
