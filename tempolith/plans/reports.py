"""What leaves the models: scored tickets, their riskiest tenth, global explanations, and checks of the assignment feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import at, days_between, display_probability, percent, rounded, sigmoid
from ..operators.ordered import quantiles
from ..params import Params
from .model_frames import THEMES, theme_of

#: Workload buckets: where each but the first begins.
WORKLOAD = (1, 3, 6, 11)


def scored_tickets(contributions: DataFrame, rows: DataFrame, base: float, p: Params) -> DataFrame:
    """One row for each ticket and point: chance of being late, as shown, the date of filing, the age at the snapshot.

    ``contributions`` (issue_key, point, feature, contribution) add up, with ``base``, to log-odds.
    """
    chance = contributions.groupBy("issue_key", "point").agg(sigmoid(F.sum("contribution") + base).alias("score"))
    return rows.join(chance, ["issue_key", "point"]).select(
        "issue_key", "point", "project_key", "issue_type", "is_late", "label_status", "score",
        F.round(display_probability(F.col("score")), 3).alias("shown"),
        F.date_format("created", "yyyy-MM-dd").alias("filed"),
        rounded(days_between(F.col("created"), at(p.snapshot)), 1).alias("age_days"),
    )


def flag_top(scored: DataFrame, known: DataFrame, share: float = 0.1) -> DataFrame:
    """``scored`` with top: whether the score reaches the cut-off above which ``share`` of the known rows of its point lie."""
    cuts = quantiles(known, ["point"], "score", {"cutoff": 1 - share}).select("point", "cutoff")
    # one row for each of the two points
    return scored.join(F.broadcast(cuts), "point").withColumn("top", F.col("score") >= F.col("cutoff"))


def open_tickets(flagged: DataFrame, point: str, projects: tuple[str, ...]) -> DataFrame:
    """Tickets whose outcome is open at one point, of some projects, the riskiest first."""
    rows = flagged.filter((F.col("label_status") == "open_unlabelled") & (F.col("point") == point) & F.col("project_key").isin(*projects))
    return rows.select("issue_key", "project_key", "issue_type", "shown", "age_days", "top").orderBy(F.desc("shown"), "issue_key")


def backtest_rates(flagged: DataFrame) -> DataFrame:
    """How many tickets of known outcome in and out of the riskiest part ran late, by point and project."""
    return flagged.filter("is_late is not null").groupBy("point", "project_key", "top").agg(F.count("*").alias("n"), F.count_if("is_late").alias("late"), percent(F.col("is_late")).alias("late_pct"))


def sample(df: DataFrame, key: Column, n: int, seed: int) -> DataFrame:
    """``n`` rows drawn without replacement, the same at every run: those of the least hashes of key and seed."""
    return df.orderBy(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))).limit(n)


def mean_sizes(contributions: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, feature, theme, mean_abs): mean sizes of the contributions."""
    found = contributions.groupBy(*groups, "feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))
    return found.withColumn("theme", theme_of(F.col("feature")))


def top_features(contributions: DataFrame, group: str, k: int = 5) -> DataFrame:
    """(group, rank, feature, theme, mean_abs): what each group's scores rest on most; a group has few features."""
    order = Window.partitionBy(group).orderBy(F.desc(F.round("mean_abs", 9)), "feature")
    return mean_sizes(contributions, [group]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def theme_importance(contributions: DataFrame, keys: list[str], order: tuple[str, ...] = tuple(THEMES)) -> DataFrame:
    """(theme, place, mean_abs): the mean size of each theme's summed contribution, with its place in a fixed order."""
    sums = contributions.groupBy(*keys, theme_of(F.col("feature")).alias("theme")).agg(F.sum("contribution").alias("_sum"))
    found = sums.groupBy("theme").agg(F.avg(F.abs("_sum")).alias("mean_abs"))
    return found.withColumn("place", F.array_position(F.array(*map(F.lit, order)), F.col("theme"))).select("theme", "place", "mean_abs")


def quantile_bins(rows: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """(bin, n, mean): mean of ``y`` in bins between quantiles of ``x``, closed above; equal edges are one. Bin -1 is where ``x`` is missing."""
    shares = {f"q{i}": i / bins for i in range(bins + 1)}
    edges = quantiles(rows.withColumn("_one", F.lit(1)), ["_one"], x, shares)
    # one row of bins + 1 numbers
    edges = edges.select(F.array_distinct(F.array(*shares)).alias("_edges"))
    inner = F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    place = F.when(F.col(x).isNull(), -1).otherwise(F.size(F.filter(inner, lambda e: e < F.col(x))))
    return rows.join(F.broadcast(edges)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(y), 6).alias("mean"))


def late_by_project_and_assigned(features: DataFrame, labels: DataFrame) -> DataFrame:
    """(project_key, assigned_pct, unassigned_pct): late rates with and without an assignee at creation, in whole percent."""
    rows = features.filter("point = 'creation'").join(labels.filter("is_late is not null").select("issue_key", "is_late"), "issue_key")
    rate = lambda flag: rounded(100 * F.avg(F.when(flag, F.col("is_late").cast("int"))), 0)
    return rows.groupBy("project_key").agg(rate(F.col("has_assignee")).alias("assigned_pct"), rate(~F.col("has_assignee")).alias("unassigned_pct"))


def assigned_after_creation(features: DataFrame, changelog: DataFrame, seconds: int = 10) -> DataFrame:
    """One row about the tickets that count as assigned at creation: their number, those first assigned within ``seconds`` after it, and those never assigned in their history."""
    claimed = features.filter("point = 'creation' and has_assignee").select("issue_key", "t_at")
    given = changelog.filter((F.lower("field") == "assignee") & F.col("to_value").isNotNull()).groupBy("issue_key").agg(F.min("created").alias("_first"))
    soon = (F.col("_first") > F.col("t_at")) & (F.col("_first") <= F.col("t_at") + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)")))
    return claimed.join(given, "issue_key", "left").agg(F.count("*").alias("n"), F.count_if(soon).alias("soon"), F.count_if(F.col("_first").isNull()).alias("never"))


def workload_range(features: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the least and the greatest late rate over buckets of the assignee's open tickets, in whole percent."""
    rows = features.filter("point = 'creation' and has_assignee").join(labels.filter("is_late is not null").select("issue_key", "is_late"), "issue_key")
    bucket = F.lit(0)
    for begin in WORKLOAD:
        bucket = bucket + F.coalesce((F.col("assignee_open") >= begin).cast("int"), F.lit(0))
    rates = rows.groupBy(bucket.alias("_bucket")).agg(rounded(100 * F.avg(F.col("is_late").cast("int")), 0).alias("_rate"))
    return rates.agg(F.min("_rate").alias("least"), F.max("_rate").alias("most"))
