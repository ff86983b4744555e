"""Intermediate tables in the folder that the cluster shares, and bounded Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import discard, settle

__all__ = ["bounded_batches", "discard", "hash_limit", "join_counted", "keep_rows", "settle", "small_table", "text_bytes"]

#: Rows handed to Python at once; with the byte bound of ``bounded_batches`` a worker holds little at a time.
BATCH_ROWS = 1000


#: A key with more rows than this is hot: its rows stay where they are, and what they are joined with is broadcast, up to
#: so many hot keys. Of more of them each is dealt to SALTS tasks.
HOT_ROWS, HOT_KEYS, SALTS = 100_000, 50_000, 64


def hash_limit(n: int, most: int) -> int:
    """The 64-bit hash up to which rows are taken so that about ``most`` of ``n`` are, at any size."""
    return min((1 << 63) - 1, -(1 << 63) + (most << 64) // max(1, n))


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, hot_rows: int = HOT_ROWS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has each key once and, in ``count``, the number of ``rows`` that have it.

    Keys of more than ``hot_rows`` rows, up to ``hot_keys`` of them, are broadcast; if there are more, each meets its rows
    in SALTS tasks. So no task gathers the rows of one key. The others are shuffled. No key is null.
    """
    hot = keyed.filter(F.col(count) > hot_rows).drop(count)
    n = hot.limit(hot_keys + 1).count()
    if not n:
        return rows.join(keyed.drop(count), on)
    usual = keyed.filter(F.col(count) <= hot_rows).drop(count)
    if n > hot_keys:
        dealt = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        copies = hot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("_hot", F.lit(True))
        found = dealt.join(copies, [*on, "_salt"], "left")
        rest = found.filter("_hot is null").select(rows.columns)
        return found.filter("_hot").drop("_salt", "_hot").unionByName(rest.join(usual, on))
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(usual, on))


def bounded_batches(spark: SparkSession) -> None:
    """Small Arrow batches, so that a worker's memory does not depend on how long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def small_table(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A few rows of the driver's, handed over as Arrow: rows as Python objects would start Python workers of their own on each executor."""
    return spark.createDataFrame(pa.table(columns))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each text of an Arrow string column, one at a time."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py()


def keep_rows(docs: DataFrame, verdict: Callable[[pa.RecordBatch], list[bool]]) -> DataFrame:
    """The rows, with all their columns, for which ``verdict`` is true; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(verdict(batch), pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
