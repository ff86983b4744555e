from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from tempolith.llm.store import join_counted, small_table


def test_hot_keys_by_broadcast_and_by_salts(spark):
    rows = spark.range(3000).select((F.col("id") % 7 * (F.col("id") % 2)).alias("a"), (F.col("id") % 3).alias("b"), "id")
    keyed = rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("id").alias("least")).filter("a <> 5")
    expected = sorted(map(tuple, rows.join(keyed.drop("n"), ["a", "b"]).select("a", "b", "id", "least").collect()))
    for hot_rows, hot_keys in ((10_000, 10), (100, 100), (100, 2), (10, 1)):
        found = join_counted(rows, keyed, ["a", "b"], "n", hot_rows, hot_keys)
        assert sorted(map(tuple, found.select("a", "b", "id", "least").collect())) == expected


def test_small_tables_start_no_python_workers(spark):
    for ids in ([], [3, 1]):
        found = small_table(spark, id=pa.array(ids, pa.int64()), goal=pa.array([0] * len(ids), pa.int32()))
        assert found.dtypes == [("id", "bigint"), ("goal", "int")] and [r["id"] for r in found.collect()] == ids
        assert "Python" not in found._jdf.queryExecution().toRdd().toDebugString()
