"""Paired bootstrap of average precision: draws are made where rows lie in order of their scores, never shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import poisson_steps
from ..sources.tables import settle

#: Rows that a task puts in order of their scores, about.
SLICE_ROWS = 1_000_000
#: Rows whose equal scores are looked for at once before they are sent on, and draws that are held at once.
BUFFER, DRAWS = 100_000, 1 << 21
#: An odd step between replicates, and the multiplier of a 32-bit mixer.
STEP, MIXER = 2654435769, 73244475

_SENT = "model int, s double, y int, seed long, n array<int>, pos array<int>"


def draws(seed: np.ndarray, replicates: int) -> np.ndarray:
    """How often each row (of a 32-bit seed) counts in each replicate: Poisson draws of mean 1."""
    x = (seed.astype(np.uint64)[:, None] + np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(STEP)) & np.uint64(0xFFFFFFFF)
    for _ in range(2):
        x = ((x ^ (x >> np.uint64(16))) * np.uint64(MIXER)) & np.uint64(0xFFFFFFFF)
    u = (((x ^ (x >> np.uint64(16))) & np.uint64((1 << 30) - 1)).astype(float) + 0.5) / (1 << 30)
    return np.searchsorted(poisson_steps(), u.ravel(), side="left").reshape(u.shape)


def _gathered(replicates: int):
    """Rows (model, s, y, seed) as they are, but many of one score in a task as one row of counts by replicate."""

    def settled(model: np.ndarray, s: np.ndarray, y: np.ndarray, seed: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((s, model))
        model, s, y, seed = model[order], s[order], y[order], seed[order]
        starts = np.flatnonzero(np.append(True, (np.diff(model) != 0) | (np.diff(s) != 0)))
        sizes = np.diff(np.append(starts, len(s)))
        many = sizes > max(8, replicates // 4)
        single = np.repeat(~many, sizes)
        none = pa.nulls(int(single.sum()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(model[single], pa.int32()), pa.array(s[single]), pa.array(y[single], pa.int32()), pa.array(seed[single], pa.int64()), none, none], names=["model", "s", "y", "seed", "n", "pos"])
        for at, size in zip(starts[many], sizes[many], strict=True):
            n, pos = np.zeros(replicates, np.int64), np.zeros(replicates, np.int64)
            step = max(1, DRAWS // replicates)
            for low in range(at, at + size, step):
                rows = slice(low, min(at + size, low + step))
                times = draws(seed[rows], replicates)
                n += times.sum(axis=0)
                pos += y[rows] @ times
            columns = [pa.array([int(model[at])], pa.int32()), pa.array([float(s[at])]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([n.tolist()], pa.list_(pa.int32())), pa.array([pos.tolist()], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["model", "s", "y", "seed", "n", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            if sum(len(h[0]) for h in held) >= BUFFER:
                yield from settled(*map(np.concatenate, zip(*held, strict=True)))
                held = []
        if held:
            yield from settled(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _counted(table: pa.Table, replicates: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(scores, counts, positive counts by replicate) of a slice's rows from the highest score down, some at a time."""
    table = table.sort_by([("s", "descending")])
    step = max(1, DRAWS // replicates)
    for at in range(0, table.num_rows, step):
        part = table.slice(at, step)
        seed = part["seed"].to_numpy(zero_copy_only=False)
        single = ~np.isnan(seed.astype(float))
        n = np.zeros((part.num_rows, replicates), np.int64)
        pos = np.zeros_like(n)
        n[single] = draws(seed[single].astype(np.int64), replicates)
        pos[single] = n[single] * part["y"].to_numpy(zero_copy_only=False)[single, None].astype(np.int64)
        for row in np.flatnonzero(~single).tolist():
            n[row], pos[row] = part["n"][row].as_py(), part["pos"][row].as_py()
        yield part["s"].to_numpy(), n, pos


def _totals(replicates: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        n, pos = np.zeros(replicates, np.int64), np.zeros(replicates, np.int64)
        for _, times, late in _counted(table, replicates):
            n, pos = n + times.sum(axis=0), pos + late.sum(axis=0)
        return pa.table({"place": pa.array([key[0].as_py()], pa.int32()), "model": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([n.tolist()], pa.list_(pa.int64())), "pos": pa.array([pos.tolist()], pa.list_(pa.int64()))})

    return run


def _precisions(replicates: int):
    """What a slice adds to each replicate's sum of precisions at its positives, given the counts before it."""

    def run(key: tuple, table: pa.Table, before: pa.Table) -> pa.Table:
        out, last, scored = np.zeros(replicates), None, np.zeros(replicates, np.int64)
        n, pos = (np.array(before[c][0].as_py() if before.num_rows else [0] * replicates, np.int64) for c in ("n", "pos"))
        scored = pos  # positives above the score that is open
        for s, times, late in _counted(table, replicates):
            if last is not None and s[0] != last:
                out, scored = out + (pos - scored) * pos / np.maximum(n, 1), pos
            upto, hits = n + np.cumsum(times, axis=0), pos + np.cumsum(late, axis=0)
            ends = np.flatnonzero(s[1:] != s[:-1])  # the last score stays open
            if len(ends):
                above = np.vstack([scored, hits[ends[:-1]]])
                out, scored = out + ((hits[ends] - above) * hits[ends] / np.maximum(upto[ends], 1)).sum(axis=0), hits[ends[-1]]
            n, pos, last = upto[-1], hits[-1], s[-1]
        out = out + (pos - scored) * pos / np.maximum(n, 1)
        return pa.table({"model": pa.array([key[1].as_py()] * replicates, pa.int32()), "replicate": pa.array(range(1, replicates + 1), pa.int32()), "part": pa.array(out)})

    return run


def bootstrap(scored: DataFrame, label: str, scores: list[str], key: str, replicates: int = 100, seed: int = 0, bits: Column | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(replicate, one average precision for each score): each row counts as often as a Poisson draw from its key and the replicate.

    ``bits`` may name another hash of the key to draw from, of which 32 bits count. All scores see the same draws, so
    differences are paired. Rows are dealt by ranges of their scores; a slice draws for its own rows, and of the slices
    above it learns one number for each replicate. Scores that many rows of a task share travel as one row of counts. A
    row without a label, or without some score, is left out of that score. A replicate without a positive gives null.
    """
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("model"), F.col(s).cast("double").alias("s")) for i, s in enumerate(scores))))
    drawn = F.pmod(F.xxhash64(key, F.lit(seed)) if bits is None else bits, F.lit(1 << 32))
    rows = scored.filter(F.col(label).isNotNull()).select(each.alias("x"), F.col(label).cast("int").alias("y"), drawn.alias("seed")).select("x.model", "x.s", "y", "seed").filter("s is not null and not isnan(s)")
    sent = settle(rows.mapInArrow(_gathered(replicates), _SENT), "draws")
    slices = max(1, -(-sent.count() // slice_rows))
    # equal scores fall into one range
    sent = settle(sent.repartitionByRange(slices, "model", F.desc("s")).withColumn("place", F.spark_partition_id()), "slices")
    totals = settle(sent.groupBy("place", "model").applyInArrow(_totals(replicates), "place int, model int, n array<long>, pos array<long>"), "totals")
    by = Window.partitionBy("model", "replicate")
    upto = by.orderBy("place")
    each = totals.select("place", "model", F.posexplode(F.arrays_zip("n", "pos")).alias("replicate", "c")).select("place", "model", "replicate", "c.n", "c.pos")
    each = each.select("place", "model", "replicate", (F.sum("n").over(upto) - F.col("n")).alias("n"), (F.sum("pos").over(upto) - F.col("pos")).alias("pos"))
    lists = F.array_sort(F.collect_list(F.struct("replicate", "n", "pos")))
    before = each.groupBy("place", "model").agg(lists.alias("l")).select("place", "model", "l.n", "l.pos")
    parts = sent.groupBy("place", "model").cogroup(before.groupBy("place", "model")).applyInArrow(_precisions(replicates), "model int, replicate int, part double")
    positives = totals.select("model", F.posexplode("pos").alias("at", "pos")).groupBy("model", (F.col("at") + 1).alias("replicate")).agg(F.sum("pos").alias("pos"))
    found = parts.groupBy("model", "replicate").agg(F.sum("part").alias("part")).join(positives, ["model", "replicate"])
    wide = found.groupBy("replicate").pivot("model", list(range(len(scores)))).agg(F.first(F.try_divide("part", "pos")))
    return wide.select("replicate", *(F.col(str(i)).alias(s) for i, s in enumerate(scores)))


def intervals(drawn: DataFrame, scores: list[str]) -> DataFrame:
    """(name, mean, low, high, wins) of each score's draws and of the later scores' leads over the first; one row a replicate comes in."""
    values = {s: F.col(s) for s in scores} | {f"{s} - {scores[0]}": F.col(s) - F.col(scores[0]) for s in scores[1:]}
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), v.alias("v")) for n, v in values.items())))
    found = drawn.select(pairs.alias("x")).groupBy("x.name").agg(F.avg("x.v").alias("mean"), F.percentile("x.v", 0.025).alias("low"), F.percentile("x.v", 0.975).alias("high"))
    return found.withColumn("wins", F.when(F.col("name").contains(" - "), F.col("low") > 0))
