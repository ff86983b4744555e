"""Operators along time within a key: ranks, running sums, as-of joins, trailing statistics, exact quantiles.

Each cuts a key's time into slices, so no task needs all rows of a key: a slice works by itself, and what it needs of the
earlier ones comes from one small row for each key and slice. A key may hold any share of the rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..sources.tables import settle

#: Seconds of a slice where the caller names none.
SLICE = 90 * 86_400


def _slice(t: Column, seconds: int) -> Column:
    return F.floor(F.unix_timestamp(t) / seconds)


def _null_safe(keys: list[str], left: str, right: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def first_by(df: DataFrame, keys: list[str], order: list[Column], rank: str | None = None) -> DataFrame:
    """The first row of each key by ``order``; keys must not be hot. With ``rank``, all rows with their number instead."""
    numbered = df.withColumn(rank or "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered if rank else numbered.filter("_rank = 1").drop("_rank")


def ranked(df: DataFrame, keys: list[str], t: str, order: list[Column], name: str, seconds: int = SLICE) -> DataFrame:
    """Each row's number (from 1) within its key by (t, order); rows with a null t come first."""
    cut = df.withColumn("_slice", F.coalesce(_slice(F.col(t), seconds), F.lit(-(1 << 40))))
    counts = cut.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_slice")) - F.col("_n")).drop("_n")
    within = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(F.col(t).asc_nulls_first(), *order))
    out = cut.withColumn("_within", within).alias("l").join(before.alias("r"), _null_safe([*keys, "_slice"], "l", "r"))
    return out.select("l.*", "r._before").withColumn(name, F.col("_before") + F.col("_within")).drop("_slice", "_before", "_within")


def next_time(df: DataFrame, keys: list[str], t: str, order: list[Column], name: str, seconds: int = SLICE) -> DataFrame:
    """Each row with the time of the next one of its key by (t, order); null for the last, and for rows without a time."""
    cut = df.withColumn("_slice", _slice(F.col(t), seconds))
    firsts = cut.dropna(subset=[t]).groupBy(*keys, "_slice").agg(F.min(t).alias("_first"))
    later = firsts.withColumn("_later", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_slice"))).drop("_first")
    within = F.when(F.col(t).isNotNull(), F.lead(t).over(Window.partitionBy(*keys, "_slice").orderBy(F.col(t), *order)))
    out = cut.withColumn(name, within).alias("l").join(later.alias("r"), _null_safe([*keys, "_slice"], "l", "r"), "left")
    return out.select("l.*", "r._later").withColumn(name, F.coalesce(name, "_later")).drop("_slice", "_later")


def running_sum(deltas: DataFrame, keys: list[str], t: str, delta: str, name: str, seconds: int = SLICE) -> DataFrame:
    """(keys, t, name): after each moment, the sum of the deltas up to and with it. Deltas of one moment are added first."""
    moments = deltas.groupBy(*keys, t).agg(F.sum(delta).alias("_d")).withColumn("_slice", _slice(F.col(t), seconds))
    sums = moments.groupBy(*keys, "_slice").agg(F.sum("_d").alias("_sum"))
    before = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_slice")) - F.col("_sum")).drop("_sum")
    within = F.sum("_d").over(Window.partitionBy(*keys, "_slice").orderBy(t))
    out = moments.withColumn("_within", within).alias("l").join(before.alias("r"), _null_safe([*keys, "_slice"], "l", "r"))
    return out.select(*(f"l.{k}" for k in keys), f"l.{t}", (F.col("_before") + F.col("_within")).alias(name))


@dataclass(frozen=True)
class Source:
    """A right side of ``asof_joins``: its keys and time, the columns that it gives under new names, which of several rows of one time is the last (nulls first)."""

    rows: DataFrame
    keys: list[str]
    t: str
    take: dict[str, str]
    tie: list[str]
    strict: bool = False
    matched: str | None = None


def asof_joins(left: DataFrame, on: list[str], left_t: str, sources: list[Source], seconds: int = SLICE) -> DataFrame:
    """All left rows with the latest row of each source of the same key at or before (``strict``: before) their time.

    All sides go through one union and one window. Null keys and times match nothing; ``matched`` names a column that
    tells whether a row was found, even if all that it gave is null.
    """
    keys = [f"_k{i}" for i in range(len(on))]
    rows = _union(left, on, left_t, sources, keys, seconds)
    each = range(len(sources))
    # one row for each key and slice: the last row of each source in it, and whether anything is asked in it
    known = rows.dropna(subset=[*keys, "_t"])
    ends = [F.max_by(f"_r{i}", F.when(F.col(f"_r{i}").isNotNull(), F.struct("_t", f"_tie{i}"))).alias(f"_r{i}") for i in each]
    marks = known.groupBy(*keys, "_slice").agg(*ends, F.bool_or(F.col("_l").isNotNull()).alias("_asks"))
    # what a slice inherits from those before it comes in as a row that precedes all of its own
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    inherited = marks.select(*keys, "_slice", "_asks", *(F.last(f"_r{i}", ignorenulls=True).over(before).alias(f"_r{i}") for i in each))
    carried = inherited.filter("_asks").dropna("all", subset=[f"_r{i}" for i in each]).drop("_asks").withColumn("_side", F.lit(-1 - len(sources)))
    return _latest(rows.unionByName(carried, allowMissingColumns=True), [*keys, "_slice"], sources)


def _union(left: DataFrame, on: list[str], left_t: str, sources: list[Source], keys: list[str], seconds: int | None) -> DataFrame:
    """Left rows as (keys, _t, _l, _side), each source's as (keys, _t, _tie<i>, _r<i>, _side); left rows of a null key are spread over slices."""
    asked = left.select(*(F.col(c).alias(k) for k, c in zip(keys, on, strict=True)), F.col(left_t).alias("_t"), F.struct("*").alias("_l"), F.lit(0).alias("_side"))
    if seconds:
        unknown = F.greatest(*(F.col(k).isNull() for k in keys), F.col("_t").isNull())
        asked = asked.withColumn("_slice", F.when(unknown, F.pmod(F.monotonically_increasing_id(), F.lit(1024))).otherwise(_slice(F.col("_t"), seconds)))
    for i, s in enumerate(sources):
        given = s.rows.select(*(F.col(c).alias(k) for k, c in zip(keys, s.keys, strict=True)), F.col(s.t).alias("_t"), F.struct(*(F.col(c) for c in s.tie)).alias(f"_tie{i}"), F.struct(F.lit(True).alias("_found"), *(F.col(c).alias(n) for c, n in s.take.items())).alias(f"_r{i}"), F.lit(1 + i if s.strict else i - len(sources)).alias("_side"))
        given = given.dropna(subset=[*keys, "_t"])
        asked = asked.unionByName(given.withColumn("_slice", _slice(F.col("_t"), seconds)) if seconds else given, allowMissingColumns=True)
    return asked


def _latest(rows: DataFrame, keys: list[str], sources: list[Source]) -> DataFrame:
    """The left rows of a union of all sides, each with the last row of each source before it."""
    order = [F.col("_t").asc_nulls_first(), "_side", *(F.col(f"_tie{i}").asc_nulls_first() for i in range(len(sources)))]
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumns({f"_m{i}": F.last(f"_r{i}", ignorenulls=True).over(before) for i in range(len(sources))}).filter("_l is not null")
    given = [F.col(f"_m{i}.{n}").alias(n) for i, s in enumerate(sources) for n in s.take.values()]
    told = [F.coalesce(F.col(f"_m{i}._found"), F.lit(False)).alias(s.matched) for i, s in enumerate(sources) if s.matched]
    return found.select("_l.*", *given, *told)


def asof_join(left: DataFrame, right: DataFrame, on: dict[str, str], left_t: str, right_t: str, take: dict[str, str], tie: list[str], strict: bool = False, seconds: int = SLICE, matched: str | None = None) -> DataFrame:
    """``asof_joins`` with one source; ``on`` maps left keys to right keys, ``take`` right columns to new names."""
    return asof_joins(left, list(on), left_t, [Source(right, list(on.values()), right_t, take, tie, strict, matched)], seconds)


def asof_join_simple(left: DataFrame, right: DataFrame, on: dict[str, str], left_t: str, right_t: str, take: dict[str, str], tie: list[str], strict: bool = False, matched: str | None = None) -> DataFrame:
    """``asof_join`` for keys of few rows, such as a ticket's own, that are never null: one exchange and one sort, no slices."""
    keys = [f"_k{i}" for i in range(len(on))]
    sources = [Source(right, list(on.values()), right_t, take, tie, strict, matched)]
    return _latest(_union(left, list(on), left_t, sources, keys, None), keys, sources)


def _blocks(df: DataFrame, keys: list[str], t: str, order: list[Column], rows: int, seconds: int) -> DataFrame:
    """``df`` with each row's place _n in its key, cut into blocks; the ``rows`` - 1 rows before a block are in it too, not its _own."""
    block = max(4096, 4 * rows)
    numbered = ranked(df, keys, t, order, "_n", seconds).withColumn("_block", F.floor((F.col("_n") - 1) / block))
    context = (F.col("_n") - 1) % block >= block - (rows - 1)
    copies = numbered.withColumn("_own", F.explode(F.when(context, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    return copies.withColumn("_block", F.when(F.col("_own"), F.col("_block")).otherwise(F.col("_block") + 1))


def trailing(df: DataFrame, keys: list[str], t: str, order: list[Column], rows: int, stats: Callable[[Window], dict[str, Column]], seconds: int = SLICE) -> DataFrame:
    """``df`` with statistics over the last ``rows`` rows of each key, the row itself included.

    ``stats`` maps a window to named columns. Rows are numbered within their key and cut into blocks; a block also gets
    the ``rows`` - 1 rows before it as context, so each block is worked out by itself.
    """
    copies = _blocks(df, keys, t, order, rows, seconds)
    w = Window.partitionBy(*keys, "_block").orderBy("_n").rowsBetween(-(rows - 1), 0)
    for name, column in stats(w).items():
        copies = copies.withColumn(name, column)
    return copies.filter("_own").drop("_n", "_block", "_own")


class _Ring:
    """The last ``rows`` values of a sequence, also in order of size."""

    def __init__(self, rows: int) -> None:
        self.rows = rows
        self.seen: deque[float | None] = deque()
        self.ordered: list[float] = []

    def add(self, value: float | None) -> float | None:
        """Take in a value (a null is none), let the oldest go, and tell the median."""
        self.seen.append(value)
        if value is not None:
            insort(self.ordered, value)
        if len(self.seen) > self.rows:
            old = self.seen.popleft()
            if old is not None:
                del self.ordered[bisect_left(self.ordered, old)]
        n = len(self.ordered)
        return (self.ordered[(n - 1) // 2] * 0.5 + self.ordered[n // 2] * 0.5) if n else None


def trailing_medians(df: DataFrame, keys: list[str], t: str, order: list[Column], rows: int, medians: dict[str, str], rates: dict[str, str], seconds: int = SLICE) -> DataFrame:
    """``df`` with n, exact medians and rates over the last ``rows`` rows of each key, the row itself included.

    ``medians`` maps new names to columns of numbers, ``rates`` to columns of 0 and 1 (or booleans); nulls count in n
    alone. Blocks are as in ``trailing``; along a block an ordered ring of the frame's values takes one value in and lets
    one go for each row, so nothing is sorted anew.
    """
    copies = _blocks(df, keys, t, order, rows, seconds)
    copies = copies.withColumns({f"_m{i}": F.col(c).cast("double") for i, c in enumerate(medians.values())} | {f"_f{i}": F.col(c).cast("int") for i, c in enumerate(rates.values())})
    spot = [*keys, "_block"]
    ordered = copies.repartition(*spot).sortWithinPartitions(*spot, "_n")
    given = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, rings, flags, sums, counts = None, 0, [], [], [], []
        for batch in batches:
            out: list[list] = [[] for _ in range(1 + len(medians) + len(rates))]
            values = [batch.column(f"_m{i}").to_pylist() for i in range(len(medians))] + [batch.column(f"_f{i}").to_pylist() for i in range(len(rates))]
            for row, here in enumerate(zip(*(batch.column(c).to_pylist() for c in spot), strict=True)):
                if here != at:
                    at, n, rings = here, 0, [_Ring(rows) for _ in medians]
                    flags, sums, counts = [deque() for _ in rates], [0] * len(rates), [0] * len(rates)
                n = min(rows, n + 1)
                out[0].append(n)
                for i, ring in enumerate(rings):
                    out[1 + i].append(ring.add(values[i][row]))
                for i, seen in enumerate(flags):
                    for flag, sign in ((values[len(medians) + i][row], 1), (seen.popleft() if len(seen) == rows else None, -1)):
                        sums[i] += sign * (flag or 0)
                        counts[i] += sign * (flag is not None)
                    seen.append(values[len(medians) + i][row])
                    out[1 + len(medians) + i].append(sums[i] / counts[i] if counts[i] else None)
            columns = [*(batch.column(c) for c in given), pa.array(out[0], pa.int64()), *(pa.array(o, pa.float64()) for o in out[1:])]
            yield pa.RecordBatch.from_arrays(columns, names=[*given, "n", *medians, *rates]).filter(batch.column("_own"))

    schema = StructType([*df.schema.fields, StructField("n", LongType()), *(StructField(c, DoubleType()) for c in (*medians, *rates))])
    return ordered.mapInArrow(run, schema)


#: Distinct values that a task puts in order; of a key with more, only the stretches that hold a wanted place are.
STRETCH = 1 << 17
#: Parts into which a stretch is cut, and the accuracy of the cuts.
PARTS, ACCURACY = 64, 4096
#: Rows of a table of stretches up to which it is broadcast.
FEW = 20_000


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], weight: Column | None = None, stretch: int = STRETCH) -> DataFrame:
    """(keys, n, one column for each share): exact interpolated quantiles of the non-null values, and their number.

    Equal values are counted first; a row counts as often as its ``weight``, a whole number, says. A key of more than
    ``stretch`` distinct values is cut at approximate quantiles of these, counts tell which parts hold a wanted place,
    and these are cut again until they are small enough. So neither the spread of the values nor their number matters
    for what a task holds; cuts change no result.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.sum(F.lit(1) if weight is None else weight).alias("_c")).filter("_c > 0")
    values = settle(counts, "values")
    sizes = values.groupBy(*keys).agg(F.count("*").alias("_d"), F.sum("_c").alias("_all"))
    # keys over ``stretch`` distinct values: so many fewer than there are values
    wide = settle(sizes.filter(F.col("_d") > stretch), "wide")
    n_wide = wide.count()
    places = {name: F.floor((F.col("_all") - 1) * share) for name, share in shares.items()}
    if not n_wide:
        found = _at_places(values.withColumn("_before", F.lit(0)), keys, keys, places)
    else:
        small = F.broadcast if n_wide <= FEW else lambda x: x
        usual = values.alias("v").join(small(wide).alias("w"), _null_safe(keys, "v", "w"), "left_anti")
        found = _at_places(usual.withColumn("_before", F.lit(0)), keys, keys, places)
        hot = values.alias("v").join(small(wide).alias("w"), _null_safe(keys, "v", "w")).select("v.*", "w._all", F.lit(0).cast("long").alias("_before"), F.lit("").alias("_path"))
        found = found.unionByName(_at_places(_narrowed(hot, keys, places, stretch), [*keys, "_path"], keys, places, known=True))
    out = [(F.col(f"_low_{n}") * (1 - rest) + F.col(f"_high_{n}") * rest).alias(n) for n, s in shares.items() for rest in [(F.col("n") - 1) * s - F.floor((F.col("n") - 1) * s)]]
    return found.select(*keys, "n", *out)


def _narrowed(rows: DataFrame, keys: list[str], places: dict[str, Column], stretch: int) -> DataFrame:
    """(keys, _v, _c, _all, _before, _path): of each key the stretches that hold a wanted place, none of more than ``stretch`` values."""
    spot = [*keys, "_path"]
    while True:
        cuts = rows.groupBy(*spot).agg(F.percentile_approx("_v", [k / PARTS for k in range(1, PARTS)], ACCURACY).alias("_cuts"))
        cuts = settle(cuts, "cuts")
        small = F.broadcast if cuts.count() <= FEW else lambda x: x
        part = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
        cut = rows.alias("v").join(small(cuts).alias("c"), _null_safe(spot, "v", "c")).select("v.*", "c._cuts").withColumn("_part", part).drop("_cuts")
        sums = cut.groupBy(*spot, "_part").agg(F.sum("_c").alias("_sum"), F.count("*").alias("_d"), F.first("_all").alias("_all"), F.first("_before").alias("_before"))
        # at most PARTS rows a window
        sums = sums.withColumn("_before", F.col("_before") + F.sum("_sum").over(Window.partitionBy(*spot).orderBy("_part")) - F.col("_sum"))
        holds = F.lit(False)
        for low in places.values():
            holds = holds | ((F.col("_before") <= low + 1) & (F.col("_before") + F.col("_sum") > low))
        kept = settle(sums.filter(holds), "kept")
        most, n = kept.agg(F.max("_d"), F.count("*")).first()
        small = F.broadcast if n <= FEW else lambda x: x
        rows = cut.drop("_before").alias("v").join(small(kept.select(*spot, "_part", "_before")).alias("k"), _null_safe([*spot, "_part"], "v", "k"))
        rows = rows.select("v.*", "k._before").withColumn("_path", F.concat_ws(".", "_path", "_part")).drop("_part")
        if most <= stretch:
            return rows
        rows = settle(rows, "stretches")


def _at_places(rows: DataFrame, spot: list[str], keys: list[str], places: dict[str, Column], known: bool = False) -> DataFrame:
    """(keys, n, _low and _high of each place): the values at each place and the one after it; ``spot`` tells the stretches of a key apart."""
    within = Window.partitionBy(*spot)
    rows = rows.withColumn("_upto", F.col("_before") + F.sum("_c").over(within.orderBy("_v")))
    if not known:
        rows = rows.withColumn("_all", F.sum("_c").over(within))
    return rows.groupBy(*keys).agg(
        F.max("_all").alias("n"),
        *(F.min(F.when(F.col("_upto") > low, F.col("_v"))).alias(f"_low_{name}") for name, low in places.items()),
        *(F.min(F.when(F.col("_upto") > F.least(low + 1, F.col("_all") - 1), F.col("_v"))).alias(f"_high_{name}") for name, low in places.items()),
    )
