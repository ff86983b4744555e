"""A session with what the library expects: UTC, ANSI errors, adaptive plans."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tempolith", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    wanted = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
    } | settings
    for key, value in wanted.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
