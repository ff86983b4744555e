"""Named tables: bucketed by a key, as views, asked with named arguments, and described."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(df: DataFrame, name: str, by: list[str] | None = None, buckets: int = 32) -> DataFrame:
    """Create or replace a table of the catalog. Tables bucketed alike by a key join on it without an exchange.

    Rows are dealt by the key before they are written, so there is one file for each bucket, sorted by the key.
    """
    writer = (df.repartition(buckets, *by) if by else df).write.mode("overwrite").format("parquet")
    if by:
        writer = writer.bucketBy(buckets, *by).sortBy(*by)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def drop(spark: SparkSession, *names: str) -> None:
    for name in names:
        spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", args={"name": name})


def view(name: str, df: DataFrame) -> DataFrame:
    """Give a frame a name that SQL of this session knows."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def ask(spark: SparkSession, sql: str, **args: object) -> DataFrame:
    """A query with named arguments, :name in the text; lists and tuples are arrays, as for array_contains(:names, column)."""
    fixed = {k: F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else v for k, v in args.items()}
    return spark.sql(sql, args=fixed)


def described(spark: SparkSession, name: str) -> dict[str, str]:
    """The columns of a table or view and their types, in order."""
    rows = spark.sql("DESCRIBE TABLE IDENTIFIER(:name)", args={"name": name}).collect()
    out = {}
    for r in rows:
        if not r["col_name"] or r["col_name"].startswith("#"):
            break
        out[r["col_name"]] = r["data_type"]
    return out
