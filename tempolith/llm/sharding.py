"""Sharding along a Hilbert curve: metadata dimensions are quantised, rows sorted by curve index, runs cut."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import settle

#: Bits of each dimension's cells.
BITS = 6


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the curve of each point; ``cells`` has a row for each dimension, values under 2**bits.

    The curve is built from its highest bit down: an exchange or an inversion of the lower bits for each bit of each
    dimension, then a Gray code over the interleaved bits.
    """
    x = cells.astype(np.int64).copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for d in range(dims):
            inverted = (x[d] >> level) & 1 == 1
            swap = (x[0] ^ x[d]) & low
            x[0] = np.where(inverted, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] = np.where(inverted, x[d], x[d] ^ swap)
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            index = index << 1 | (x[d] >> level) & 1
    return index


def _number(df: DataFrame, name: str, ends: dict) -> F.Column:
    """A number in the order of the column's values; strings by the six bytes after the start that all share."""
    if dict(df.dtypes)[name] != "string":
        return F.col(name).cast("double")
    low, high = (ends[f"{end}_{name}"] or "" for end in ("low", "high"))
    shared = next((i for i, (a, b) in enumerate(zip(low.encode(), high.encode(), strict=False)) if a != b), min(len(low.encode()), len(high.encode())))
    six = F.substring(F.concat(F.encode(F.col(name), "UTF-8"), F.lit(bytes(6))), shared + 1, 6)
    return F.conv(F.hex(six), 16, 10).cast("double")


def _cells(df: DataFrame, dims: list[str], bits: int) -> DataFrame:
    """Cells of each dimension, cut at quantiles of all rows and spread over the whole range, so a dimension of few values
    parts the curve as early as one of many; null is the lowest cell."""
    ends = df.agg(*(f(n).alias(f"{end}_{n}") for n in dims for f, end in ((F.min, "low"), (F.max, "high")))).first().asDict()
    for n in dims:
        df = df.withColumn(f"_v_{n}", _number(df, n, ends))
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    most = {f"most {n}": F.max(f"_v_{n}") for n in dims}
    cuts = df.agg(*(F.percentile_approx(f"_v_{n}", shares, 10_000).alias(n) for n in dims), *(m.alias(k) for k, m in most.items())).first().asDict()
    for n in dims:
        value, edges = F.col(f"_v_{n}"), sorted({e for e in cuts[n] or [] if e < cuts[f'most {n}']})  # none lies above the greatest
        below = sum((F.when(value > e, 1).otherwise(0) for e in edges), F.lit(0))
        spread = F.expr(f"(_below << {bits}) div {len(edges) + 1}")
        df = df.withColumn("_below", F.when(value.isNull(), 0).otherwise(below)).withColumn(f"_c_{n}", spread.cast("int")).drop(f"_v_{n}", "_below")
    return df


def hilbert_shards(rows: DataFrame, dims: list[str], shards: int, tie: list[str], bits: int = BITS) -> DataFrame:
    """``rows`` with shard (0 to shards - 1) and slot (from 0 in each shard), counts at most one apart.

    Rows are sorted by the curve index of ``dims`` (numbers, dates or strings), then by ``tie``, and cut into runs of
    equal length, so each shard covers a small range of every dimension. The sort is by range, with no task that sees
    all rows. Nulls come first, repeated rows lie side by side, an empty table gives an empty one.
    """

    @F.pandas_udf("long")
    def index(*cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in cells]), bits))

    cells = [f"_c_{n}" for n in dims]
    df = _cells(rows, dims, bits).withColumn("_h", index(*cells)).drop(*cells)
    order = ["_h", *tie]
    # the place in the sorted partition is written with the row, so later steps agree on it
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    ranged = settle(ranged.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_h"), "ranged")
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    # one row for each partition
    starts = counts.withColumn("_start", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    df = ranged.join(F.broadcast(starts.drop("_n")), "_p")
    rank = F.col("_start") + F.col("_i")
    shard = F.expr(f"((_start + _i) * {shards}) div _all")
    df = df.withColumn("shard", shard.cast("int")).withColumn("slot", rank - F.expr(f"(shard * _all + {shards - 1}) div {shards}"))
    return df.drop("_p", "_i", "_start", "_all")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document, by language, source and size.

    ``size`` is the text's UTF-8 bytes (null: none) plus 8; a null text has the checksum of an empty one. Equal texts of
    a language and source lie side by side, unless a cut falls between them. The law is ``rows``; a larger number of shards cuts anew, so grown_shard is
    null. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = settle(rows, "sizes")
    placed = hilbert_shards(rows, ["lang", "source", "size"], shards, ["text_crc32", "doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, shards: DataFrame, path: str) -> None:
    """The documents as one folder of Parquet files for each shard, in the order of slots."""
    rows = docs.join(shards.select("doc_id", "shard", "slot"), "doc_id")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
