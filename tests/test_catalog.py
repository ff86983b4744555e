from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from tempolith.sources import catalog


@pytest.fixture
def named(spark):
    one = spark.range(500).select(F.col("id").alias("issue_key"), (F.col("id") % 4).cast("string").alias("project_key"))
    two = spark.range(0, 1000, 3).select(F.col("id").alias("issue_key"), (F.col("id") * 0.5).alias("days"))
    catalog.save(one, "own_tickets", ["issue_key"], 4)
    catalog.save(two, "own_days", ["issue_key"], 4)
    yield
    catalog.drop(spark, "own_tickets", "own_days", "own_none")


def test_bucketed_tables_join_without_an_exchange(spark, named):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("own_tickets").join(spark.table("own_days"), "issue_key")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" in plan
        grouped = spark.table("own_tickets").groupBy("issue_key").count()
        assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 167
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tables_are_replaced_and_described(spark, named):
    assert catalog.described(spark, "own_tickets") == {"issue_key": "bigint", "project_key": "string"}
    catalog.save(spark.range(3).select(F.lit("x").alias("other")), "own_tickets")
    assert catalog.described(spark, "own_tickets") == {"other": "string"} and spark.table("own_tickets").count() == 3


def test_named_arguments(spark, named):
    late = catalog.view("own_late", spark.table("own_tickets").filter("issue_key > 100"))
    assert late.count() == 399 and catalog.described(spark, "own_late") == {"issue_key": "bigint", "project_key": "string"}
    found = catalog.ask(spark, "SELECT count(*) AS n FROM own_late WHERE array_contains(:projects, project_key) AND issue_key < :least", projects=["1", "3"], least=200)
    assert found.first()["n"] == sum(i % 4 in (1, 3) for i in range(101, 200))
    odd = "1' OR '1' = '1"
    assert catalog.ask(spark, "SELECT * FROM own_late WHERE project_key = :p", p=odd).count() == 0
