"""A ticket model over the order tables: orders are tickets, their lines are changes and comments.

It gives every layer something to work on where no issue tracker's history is at hand.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..params import Params
from .relations import Relations

STATUSES = ("Open", "In Progress", "Patch Available", "Resolved", "Reopened", " testing ")
STAGES = (("Open", "Waiting"), ("Reopened", "Waiting"), ("In Progress", "Building"), ("Patch Available", "In review"), ("Testing", "In review"), ("Resolved", "Done"), ("Closed", "Done"))
PRIORITIES = ("Major", "Blocker", " minor", "P0")
RANKS = (("Blocker", 1.0), ("Critical", 0.75), ("Major", 0.5), ("Minor", 0.25), ("Trivial", 0.0))
PARAMS = Params(
    projects=("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"),
    excluded_types=("5-LOW",),
    delivered=("Fixed", "Done"),
    min_created=datetime(1995, 3, 1),
    snapshot=datetime(2001, 11, 5),
    train_cutoff=datetime(1999, 1, 1),
    test_start=datetime(1999, 3, 1),
    test_end=datetime(2001, 1, 1),
    too_fast_hours=240,
    bulk_min=3,
    min_group=12,
    peer_window=50,
    review_projects=("AUTOMOBILE", "BUILDING"),
    factor_min=20,
)


#: The tables that the model is made of.
TABLES = ("orders", "customer", "lineitem", "events")


def _later(t: Column, seconds: Column) -> Column:
    return t + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def _one_of(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index + 1).cast("int"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, lines = (read(spark, sf_dir, n) for n in ("orders", "customer", "lineitem"))
    # an order's lines meet once, in order of supplier; windows hold one order at a time, and leave the order that the join needs
    own = Window.partitionBy("l_orderkey").orderBy(F.col("l_suppkey").asc_nulls_last())
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per_order = lines.filter("l_orderkey is not null").select(
        "l_orderkey", F.max("l_shipdate").over(whole).alias("last_ship"), F.min("l_suppkey").over(whole).alias("supp"), F.count("*").over(whole).alias("n_lines"),
        (F.dense_rank().over(own) - F.col("l_suppkey").isNull().cast("int")).cast("long").alias("n_supp"), F.row_number().over(own).alias("_n"),
    ).filter("_n = n_lines").drop("_n")
    key, cust, state = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    rows = orders.join(customer.select("c_custkey", "c_mktsegment"), orders.o_custkey == F.col("c_custkey")).join(per_order, key == F.col("l_orderkey"), "left")
    return rows.select(
        key.alias("issue_key"),
        F.col("c_mktsegment").alias("project_key"),
        F.col("o_orderpriority").alias("issue_type"),
        F.when(state == "F", "Resolved").when(state == "P", "Closed").when(key % 97 == 0, "Parked").otherwise(" OPEN ").alias("status"),
        F.when(state == "F", "Fixed").when(state == "P", "Duplicate").alias("resolution"),
        F.when(key % 5 < 4, _one_of(PRIORITIES, F.least(key % 5, F.lit(3)))).alias("priority"),
        _later(F.col("o_orderdate"), key * 7919 % 86400).alias("created"),
        F.when(state != "O", _later(F.col("last_ship"), cust * 104729 % 86400)).alias("resolution_date"),
        F.when(key % 6 != 0, (F.col("supp") % 40).cast("string")).alias("assignee"),
        F.when(key % 11 != 0, cust).alias("reporter"),
        F.when(key % 13 != 0, F.array_repeat(F.lit("c"), (F.coalesce("n_lines", F.lit(0)) % 4).cast("int"))).alias("components"),
        F.coalesce("n_supp", F.lit(0)).alias("link_count"),
        F.coalesce("n_lines", F.lit(0)).alias("comment_count"),
    )


def changelog(spark: SparkSession, sf_dir: str, tickets: DataFrame) -> DataFrame:
    line, part, supp, qty = (F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    is_ = lambda *n: line.isin(*n)
    link = is_(6) & (part % 2 == 0)
    marks = is_(4) | link
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("issue_key"),
        F.when(part % 50 == 0, "x").otherwise((part * 10 + line).cast("string")).alias("history_id"),
        _later(F.col("l_shipdate"), part * 31 % 86400).alias("created"),
        F.concat(F.lit("u"), (supp % 7).cast("string")).alias("author"),
        F.when(is_(1, 2), "status").when(is_(3), "assignee").when(is_(4), "Component").when(is_(5), "priority").when(link, "Link").when(is_(6), "summary").otherwise("issuetype").alias("field"),
        F.when(is_(3), (supp % 40).cast("string")).alias("from_value"),
        F.when(is_(1, 2), _one_of(STATUSES, part % 6))
        .when(marks & (part % 4 != 0), "c")
        .when(is_(5) & (part % 3 != 0), _one_of(PRIORITIES, part % 4))
        .when(is_(6) & ~link, F.repeat(F.lit("x"), qty.cast("int")))
        .when(is_(7), _one_of(("1-URGENT", "3-MEDIUM"), part % 2))
        .alias("from_string"),
        F.when(is_(3) & (part % 5 != 0), (part % 40).cast("string")).alias("to_value"),
        F.when(is_(1, 2), _one_of(STATUSES, supp % 6)).when(marks & (supp % 3 != 0), "d").when(~marks, "v").alias("to_string"),
    )
    done = tickets.filter("resolution_date is not null").select(
        "issue_key", F.lit("900").alias("history_id"), F.date_trunc("day", "resolution_date").cast("timestamp_ntz").alias("created"), F.concat(F.lit("u"), (F.col("issue_key") % 7).cast("string")).alias("author"),
        F.lit("resolution").alias("field"), F.lit(None).cast("string").alias("from_value"), F.lit(None).cast("string").alias("from_string"), F.lit(None).cast("string").alias("to_value"), F.col("resolution").alias("to_string"),
    )
    return rows.unionByName(done)


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").filter("l_linenumber >= 4")
    return rows.select(F.col("l_orderkey").alias("issue_key"), _later(F.col("l_shipdate"), F.col("l_partkey") * 17 % 86400 - 864_000).alias("created"), F.concat(F.lit("c"), (F.col("l_partkey") % 9).cast("string")).alias("author"))


def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(key.alias("issue_key"), (key % 90).alias("summary_length"), F.when(key % 8 != 0, F.col("o_custkey") % 700).alias("description_length"))


def relations(spark: SparkSession, sf_dir: str, tickets: DataFrame | None = None) -> Relations:
    """``tickets`` are the issues where someone has worked them out already."""
    tickets = issues(spark, sf_dir) if tickets is None else tickets
    return Relations(tickets, changelog(spark, sf_dir, tickets), comments(spark, sf_dir), text_stats(spark, sf_dir))


def _values(spark: SparkSession, rows: tuple[tuple, ...], *names: str) -> DataFrame:
    """A few literal rows, without a Python worker."""
    structs = [F.struct(*(F.lit(v).alias(n) for v, n in zip(row, names, strict=True))) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def stage_map(spark: SparkSession) -> DataFrame:
    return _values(spark, tuple((s.strip().lower(), g) for s, g in STAGES), "status_key", "stage")


def priority_ranks(spark: SparkSession) -> DataFrame:
    return _values(spark, tuple((p.lower(), r) for p, r in RANKS), "priority_key", "rank")
