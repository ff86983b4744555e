"""Checks that return problems: rows lost in loading, doubled keys, orphans, dates, statuses, labels, leaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import naive_utc, rounded


def doubled_keys(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue_key").agg(F.count("*").alias("n")).filter("n > 1")


def orphans(children: DataFrame, issues: DataFrame) -> DataFrame:
    """Child rows whose ticket is not there, as NOT IN counts them: a row without a key is none, and if a ticket's key is missing, no row is known to be one."""
    missing = issues.agg(F.coalesce(F.bool_or(F.col("issue_key").isNull()), F.lit(False)).alias("_missing"))  # one row
    sure = children.filter("issue_key is not null").join(F.broadcast(missing)).filter("not _missing").drop("_missing")
    return sure.join(issues.select("issue_key"), "issue_key", "left_anti")


def lost_rows(loaded: DataFrame, source: DataFrame, doubled: DataFrame) -> DataFrame:
    """One row of counts, and whether more rows are gone than belong to doubled tickets."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    own = source.join(doubled.select("issue_key"), "issue_key", "left_semi")
    # one row each
    row = n(loaded, "loaded").join(F.broadcast(n(source, "source"))).join(F.broadcast(n(own, "in_doubled")))
    return row.withColumn("problem", (F.col("loaded") > F.col("source")) | (F.col("source") - F.col("loaded") > F.col("in_doubled")))


def unparseable(raw: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n): dates that are given but are none."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), (F.col(c).isNotNull() & naive_utc(F.col(c)).isNull()).alias("bad")) for c in columns)))
    return raw.select(pairs.alias("x")).groupBy("x.column").agg(F.count_if(F.col("x.bad")).alias("n"))


def unmapped_statuses(intervals: DataFrame) -> DataFrame:
    return intervals.filter("stage = 'Unmapped'").groupBy("status").agg(F.count("*").alias("n"))


def labelable_share(labels: DataFrame, least: float = 0.9) -> DataFrame:
    """Of the test window's tickets that could be labelled, how many are; one row."""
    rows = labels.filter((F.col("split") == "test") & ~F.col("label_status").like("excluded:%") & (F.col("label_status") != "not_delivered"))
    known = F.count_if(F.col("label_status").isin("labelled", "open_known_late"))
    able = F.count_if(F.col("label_status").isin("labelled", "open_known_late", "open_unlabelled"))
    out = rows.agg(known.alias("known"), able.alias("able")).withColumn("share", rounded(F.coalesce(F.try_divide(F.col("known"), F.col("able")), F.lit(0.0)), 4))
    return out.withColumn("problem", F.col("share") < least)


def filled_at_creation(features: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n): values that a creation row has in columns known only later; all must be 0."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).isNotNull().alias("set")) for c in columns)))
    return features.filter("point = 'creation'").select(pairs.alias("x")).groupBy("x.column").agg(F.count_if(F.col("x.set")).alias("n"))
