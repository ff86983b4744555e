"""Logistic models fitted together: each step is one pass over the rows, whatever the number of models.

The models share rows and plain columns; each has its own weights of the rows, strength of the penalty, columns left out,
and its own medians, means and deviations, which are folded into the coefficients. So a grid over folds, refits on
resampled rows and refits without some columns cost as many passes as one model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import metrics
from ..functions.scalar import at
from ..operators.ordered import quantiles
from ..sources.tables import settle
from .model_frames import feature_columns, known_at_flag, long_form

#: Numbers of the sums of one pass, of all models in it; more models take further passes.
SUMS = 1 << 22
#: Partial sums of a model that one task adds up.
FAN = 64
#: Newton steps, and the size of the last one, as a share of the coefficients.
STEPS, CLOSE = 60, 1e-9
#: Levels of all categorical columns.
LEVELS = 2000


@dataclass(frozen=True)
class Spec:
    """A model to fit: how often each row counts in training (a whole number; null as 0), sklearn's C, columns left out."""

    name: str
    weight: Column
    C: float
    without: tuple[str, ...] = ()


@dataclass(frozen=True)
class Layout:
    """The plain columns: of each number its value (0 where missing) and whether it is missing, of each category its levels and 'none of them'; last, one."""

    numbers: tuple[str, ...]
    logged: frozenset[str]
    levels: dict[str, list[str]]

    @property
    def width(self) -> int:
        return 2 * len(self.numbers) + sum(len(v) + 1 for v in self.levels.values()) + 1

    def places(self) -> dict[str, np.ndarray]:
        """Where each column lies among the plain ones."""
        out, begin = {c: np.array([2 * k, 2 * k + 1]) for k, c in enumerate(self.numbers)}, 2 * len(self.numbers)
        for c, levels in self.levels.items():
            out[c] = np.arange(begin, begin + len(levels) + 1)
            begin += len(levels) + 1
        return out

    def matrix(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((batch.num_rows, self.width))
        for k, c in enumerate(self.numbers):
            column = batch.column(c)
            missing = pc.is_null(column, nan_is_null=True).to_numpy(zero_copy_only=False)
            values = np.where(missing, 0.0, column.to_numpy(zero_copy_only=False).astype(float))
            out[:, 2 * k] = np.log1p(np.maximum(values, 0.0)) if c in self.logged else values
            out[:, 2 * k + 1] = missing
        begin = 2 * len(self.numbers)
        for c, levels in self.levels.items():
            code = pc.fill_null(pc.index_in(batch.column(c).cast(pa.string()), value_set=pa.array(levels, pa.string())), len(levels)).to_numpy(zero_copy_only=False)
            out[np.arange(len(code)), begin + code] = 1.0
            begin += len(levels) + 1
        out[:, -1] = 1.0
        return out


@dataclass(frozen=True)
class Linear:
    """A fitted model in plain columns: log-odds are their products with ``weights``; ``shift`` is what each column adds of its own."""

    name: str
    layout: Layout
    weights: np.ndarray
    shift: dict[str, float] = field(default_factory=dict)

    def base(self) -> float:
        """The log-odds that contributions start from."""
        return float(self.weights[-1]) - sum(self.shift.values())


def _selected(frame: DataFrame, layout: Layout) -> list[Column]:
    return [*(F.col(c).cast("double").alias(c) for c in layout.numbers), *(F.col(c).cast("string").alias(c) for c in layout.levels)]


def _summed(rows: DataFrame, vectors: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """The sums over all tasks of the vectors that each makes of its rows; they are added up in a tree."""
    schema = "model int, part int, v binary"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for model, v in vectors(batches).items():
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.int32()), pa.array([part], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["model", "part", "v"])

    def added(table: pa.Table) -> pa.Table:
        v = sum(np.frombuffer(b.as_py()) for b in table["v"])
        return pa.table({"model": table["model"].slice(0, 1), "part": table["part"].slice(0, 1), "v": pa.array([v.tobytes()], pa.binary())})

    found = rows.mapInArrow(partial, schema)
    # parts of neighbouring tasks first, then all of a model
    found = found.groupBy("model", F.floor(F.col("part") / FAN).alias("_group")).applyInArrow(added, schema)
    return {r["model"]: np.frombuffer(r["v"]).copy() for r in found.groupBy("model").applyInArrow(added, schema).collect()}


def plain_columns(point: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The numbers and the categories that models of a point rest on."""
    kinds = feature_columns(point)
    return tuple(c for c in (*kinds["log"], *kinds["linear"]) if not (c == "has_assignee" and point == "creation")), tuple(kinds["categorical"])


def prepared(frame: DataFrame, point: str, specs: Sequence[Spec], label: str = "is_late") -> tuple[DataFrame, Layout]:
    """(the plain columns' sources, _y, _w) of the rows that count in some model, written once; and the layout."""
    numbers, categories = plain_columns(point)
    weights = F.array(*(F.coalesce(s.weight.cast("int"), F.lit(0)) for s in specs))
    rows = frame.filter(F.col(label).isNotNull()).withColumn("_w", weights).filter(F.exists("_w", lambda w: w > 0))
    rows = settle(rows.select(*(F.col(c).cast("double").alias(c) for c in numbers), *(F.col(c).cast("string").alias(c) for c in categories), F.col(label).cast("double").alias("_y"), "_w"), "design")
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("level")) for c in categories)))
    found = rows.select(pairs.alias("x")).select("x.*").dropna().distinct().orderBy("c", "level").limit(LEVELS + 1).collect()
    if len(found) > LEVELS:
        raise ValueError(f"more than {LEVELS} levels of {categories}")
    return rows, Layout(numbers, frozenset(feature_columns(point)["log"]), {c: [r["level"] for r in found if r["c"] == c] for c in categories})


def _medians(rows: DataFrame, layout: Layout, n: int) -> np.ndarray:
    """The median of each number (column) in each model (row), as it is filled in; 0 where there is none."""
    long = long_form(rows, ["_w"], {c: F.col(c) for c in layout.numbers})
    counts = long.dropna(subset=["value"]).groupBy("feature", "value").agg(*(F.sum(F.col("_w")[j]).alias(f"w{j}") for j in range(n)))
    each = F.explode(F.filter(F.array(*(F.struct(F.lit(j).alias("model"), F.col(f"w{j}").alias("n")) for j in range(n))), lambda x: x["n"] > 0))
    found = quantiles(counts.select("feature", "value", each.alias("x")).select("feature", "value", "x.*"), ["model", "feature"], "value", {"mid": 0.5}, weight=F.col("n"))
    out = np.zeros((n, len(layout.numbers)))
    for r in found.collect():
        out[r["model"], layout.numbers.index(r["feature"])] = np.log1p(max(r["mid"], 0.0)) if r["feature"] in layout.logged else r["mid"]
    return out


def _moments(rows: DataFrame, layout: Layout, medians: np.ndarray) -> dict[int, np.ndarray]:
    """Of each model: weight, weight of the positives, then of each number the sums of its distance to the median and of the squares, then of each level its weight."""
    begin = 2 * len(layout.numbers)

    def vectors(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            x, y, w = _unpacked(batch, layout)
            for j in range(w.shape[1]):
                some = np.flatnonzero(w[:, j])
                if len(some):
                    wj, xj = w[some, j], x[some]
                    away = (xj[:, 0:begin:2] - medians[j]) * (1 - xj[:, 1:begin:2])
                    out[j] = out.get(j, 0) + np.concatenate([[wj.sum(), wj @ y[some]], wj @ away, wj @ away**2, wj @ xj[:, begin:-1]])
        return out

    return _summed(rows, vectors)


def _unpacked(batch: pa.RecordBatch, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = batch.column("_w")
    return layout.matrix(batch), batch.column("_y").to_numpy(), lists.flatten().to_numpy().astype(float).reshape(batch.num_rows, -1)


def _slopes(rows: DataFrame, layout: Layout, at_: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Of each model at its place: the loss, its gradient and the upper half of its second derivatives, in plain columns."""
    upper = np.triu_indices(layout.width)

    def vectors(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        sums = {j: [0.0, np.zeros(layout.width), np.zeros((layout.width, layout.width))] for j in at_}
        for batch in batches:
            x, y, w = _unpacked(batch, layout)
            for j, (_, gradient, second) in sums.items():
                some = np.flatnonzero(w[:, j])
                if len(some):
                    xj, wj, yj = x[some], w[some, j], y[some]
                    m = xj @ at_[j]
                    p = 1 / (1 + np.exp(-np.clip(m, -700, 700)))
                    sums[j][0] += float(wj @ (np.logaddexp(0, m) - yj * m))
                    gradient += xj.T @ (wj * (p - yj))
                    second += xj.T @ (xj * (wj * p * (1 - p))[:, None])
        return {j: np.concatenate([[loss], gradient, second[upper]]) for j, (loss, gradient, second) in sums.items()}

    return _summed(rows, vectors)


@dataclass
class _Scale:
    """How a model's own coefficients (of scaled numbers, gaps, levels, intercept) become those of plain columns."""

    turn: np.ndarray
    shift: np.ndarray
    free: np.ndarray
    merged: list[tuple[int, int]]

    @classmethod
    def of(cls, spec: Spec, layout: Layout, medians: np.ndarray, moments: np.ndarray) -> _Scale:
        n, k = moments[0], len(layout.numbers)
        mean = medians + moments[2 : 2 + k] / n
        deviation = np.sqrt(np.maximum(moments[2 + k : 2 + 2 * k] / n - (moments[2 : 2 + k] / n) ** 2, 0.0))
        deviation = np.where(deviation > 0, deviation, 1.0)
        turn, shift = np.eye(layout.width), np.zeros(layout.width)
        for i in range(k):
            turn[2 * i, 2 * i] = 1 / deviation[i]
            turn[2 * i + 1, 2 * i] = medians[i] / deviation[i]
            turn[-1, 2 * i] = shift[2 * i] = -mean[i] / deviation[i]
        places = layout.places()
        left_out = np.concatenate([places[c] for c in spec.without if c in places] or [np.empty(0, int)]).astype(int)
        free = np.setdiff1d(np.arange(layout.width), left_out)
        # a level that training never saw scores as none of them
        weight = moments[2 + 2 * k :]
        merged = [(int(p), int(places[c][-1])) for c in layout.levels for p in places[c][:-1] if weight[p - 2 * k] == 0]
        return cls(turn, shift, free, merged)

    def plain(self, own: np.ndarray) -> np.ndarray:
        out = self.turn @ own
        for level, none in self.merged:
            out[level] = out[none]
        return out


def fit_together(frame: DataFrame, point: str, specs: Sequence[Spec], label: str = "is_late") -> list[Linear | None]:
    """A model for each spec, the minimum of its summed log loss plus half the squared coefficients over C; the intercept is free.

    Gaps are filled with the model's median beside a column that tells of them, numbers are scaled by its mean and
    deviation, counts after log(1 + x). A model whose rows lack a class is None. All models take their Newton steps in the
    same passes; one whose loss rises goes back half the way. Only sums come to the driver, of as many models at once as
    SUMS allows.
    """
    if not specs:
        return []
    rows, layout = prepared(frame, point, specs, label)
    medians = _medians(rows, layout, len(specs))
    moments = _moments(rows, layout, medians)
    able = [j for j in range(len(specs)) if j in moments and 0 < moments[j][1] < moments[j][0]]
    scales = {j: _Scale.of(specs[j], layout, medians[j], moments[j]) for j in able}
    own = {j: np.zeros(layout.width) for j in able}
    best: dict[int, tuple[float, np.ndarray]] = {}
    going = list(able)
    upper = np.triu_indices(layout.width)
    at_once = max(1, SUMS // len(upper[0]))
    for _ in range(STEPS):
        if not going:
            break
        still = []
        for begin in range(0, len(going), at_once):
            some = going[begin : begin + at_once]
            sums = _slopes(rows, layout, {j: scales[j].turn @ own[j] for j in some})
            for j in some:
                if _step(specs[j], scales[j], sums[j], own, best, j, upper):
                    still.append(j)
        going = still
    out: list[Linear | None] = []
    for j, spec in enumerate(specs):
        if j not in scales:
            out.append(None)
            continue
        shift = {c: float(scales[j].shift[2 * i] * own[j][2 * i]) for i, c in enumerate(layout.numbers)}
        out.append(Linear(spec.name, layout, scales[j].plain(own[j]), shift))
    return out


def _step(spec: Spec, scale: _Scale, sums: np.ndarray, own: dict[int, np.ndarray], best: dict[int, tuple[float, np.ndarray]], j: int, upper: tuple) -> bool:
    """Move one model; whether it has further to go."""
    width = len(own[j])
    penalty = np.full(width, 1 / spec.C)
    penalty[-1] = 0.0
    loss = sums[0] + 0.5 * penalty @ own[j] ** 2
    if j in best and loss > best[j][0] + 1e-12 * abs(best[j][0]):
        own[j] = (own[j] + best[j][1]) / 2
        return True
    best[j] = loss, own[j]
    second = np.zeros((width, width))
    second[upper] = sums[1 + width :]
    second = second + np.triu(second, 1).T
    gradient = (scale.turn.T @ sums[1 : 1 + width] + penalty * own[j])[scale.free]
    curved = (scale.turn.T @ second @ scale.turn + np.diag(penalty))[np.ix_(scale.free, scale.free)]
    move = np.zeros(width)
    move[scale.free] = np.linalg.lstsq(curved, gradient, rcond=None)[0] if np.linalg.cond(curved) > 1e13 else np.linalg.solve(curved, gradient)
    own[j] = own[j] - move
    return bool(np.abs(move).max() > CLOSE * max(1.0, np.abs(own[j]).max()))


def scored_together(frame: DataFrame, models: Sequence[Linear]) -> DataFrame:
    """``frame`` with scores, the chance of being late by each model."""
    layout, weights = models[0].layout, np.stack([m.weights for m in models], axis=1)
    given = frame.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = pa.RecordBatch.from_arrays([batch.column(f"_x_{c}") for c in (*layout.numbers, *layout.levels)], names=[*layout.numbers, *layout.levels])
            chance = 1 / (1 + np.exp(-np.clip(layout.matrix(plain) @ weights, -700, 700)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(chance) + 1, dtype=np.int32) * len(models)), pa.array(chance.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(given))), lists], names=[*given, "scores"])

    used = [c.alias(f"_x_{n}") for c, n in zip(_selected(frame, layout), (*layout.numbers, *layout.levels), strict=True)]
    schema = StructType([*frame.schema.fields, StructField("scores", ArrayType(DoubleType()))])
    return frame.select("*", *used).mapInArrow(run, schema)


def contributions_together(frame: DataFrame, keys: list[str], models: Sequence[Linear]) -> DataFrame:
    """(keys, model, feature, contribution): additive parts of each model's log-odds, which add up to them less its ``base``."""
    layout, places = models[0].layout, models[0].layout.places()
    names = list(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = layout.matrix(batch)
            for model in models:
                parts = np.stack([plain[:, at_] @ model.weights[at_] + model.shift.get(c, 0.0) for c, at_ in places.items()], axis=1)
                rows = np.repeat(np.arange(len(plain)), len(names))
                columns = [batch.column(k).take(pa.array(rows)) for k in keys]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([model.name] * len(rows)), pa.array(names * len(plain)), pa.array(parts.ravel())], names=[*keys, "model", "feature", "contribution"])

    own = [f for f in frame.schema.fields if f.name in keys]
    schema = StructType([*(next(f for f in own if f.name == k) for k in keys), *StructType.fromDDL("model string, feature string, contribution double").fields])
    return frame.select(*keys, *_selected(frame.drop(*keys), layout)).mapInArrow(run, schema)


def importance_together(frame: DataFrame, models: Sequence[Linear]) -> dict[str, dict[str, float]]:
    """For each model the mean size of each feature's contribution, in one pass."""
    if not models:
        return {}
    layout, places = models[0].layout, models[0].layout.places()

    def vectors(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            plain = layout.matrix(batch)
            for j, model in enumerate(models):
                sizes = [np.abs(plain[:, at_] @ model.weights[at_] + model.shift.get(c, 0.0)).sum() for c, at_ in places.items()]
                out[j] = out.get(j, 0) + np.array([len(plain), *sizes])
        return out

    sums = _summed(frame.select(*_selected(frame, layout)), vectors)
    return {m.name: dict(zip(places, (sums[j][1:] / sums[j][0]).tolist(), strict=True)) for j, m in enumerate(models) if j in sums}


def precision_together(scored: DataFrame, models: Sequence[Linear], holds: Sequence[Column], label: str = "is_late") -> DataFrame:
    """(model, n, average_precision, roc_auc) of each model over the rows that hold for it; ``scored`` has scores."""
    each = F.explode(F.array(*(F.struct(F.lit(m.name).alias("model"), F.col("scores")[j].alias("s"), F.coalesce(h, F.lit(False)).alias("holds")) for j, (m, h) in enumerate(zip(models, holds, strict=True)))))
    rows = scored.select(F.col(label).cast("int").alias("_y"), each.alias("x")).filter("x.holds").select("_y", "x.model", "x.s")
    counts = metrics.score_counts(rows, "_y", "s", ["model"])
    return counts.groupBy("model").agg(F.max("_n_all").alias("n"), metrics.average_precision().alias("average_precision"), metrics.roc_auc().alias("roc_auc"))


def fold_flags(cutoff: datetime) -> tuple[Column, Column]:
    """Whether a row trains (it was known at the cutoff), and whether it validates (it was filed in the year after)."""
    year = (F.col("created") >= at(cutoff)) & (F.col("created") < at(cutoff.replace(year=cutoff.year + 1)))
    return known_at_flag(cutoff), year & F.col("is_late").isNotNull()


def tune_together(point: str, frame: DataFrame, cutoffs: tuple[datetime, ...], grid: Sequence[float], min_train: int, min_valid: int) -> DataFrame:
    """(c, cutoff, n_train, n_valid, average_precision) of each C and fold, all fitted together; folds too small or of one class are left out."""
    flags = {c: fold_flags(c) for c in cutoffs}
    counts = frame.agg(*(x for c in cutoffs for k, hold in enumerate(flags[c]) for x in (F.count_if(hold).alias(f"{c} {k} n"), F.count_if(hold & (F.col("is_late") == 1)).alias(f"{c} {k} late")))).first()
    fits = [c for c in cutoffs if all(counts[f"{c} {k} n"] >= least and 0 < counts[f"{c} {k} late"] < counts[f"{c} {k} n"] for k, least in enumerate((min_train, min_valid)))]
    spark = frame.sparkSession
    schema = "c double, cutoff timestamp_ntz, n_train long, n_valid long, average_precision double"
    if not fits:
        return spark.createDataFrame([], schema)
    named = {f"{C!r} {c.isoformat()}": (C, c) for C in grid for c in fits}
    models = fit_together(frame, point, [Spec(n, flags[c][0].cast("int"), C) for n, (C, c) in named.items()])
    valid = scored_together(frame.filter(reduce(or_, (flags[c][1] for c in fits))), models)
    found = precision_together(valid, models, [flags[c][1] for _, c in named.values()])
    # a row for each model
    facts = spark.createDataFrame([(n, C, c, counts[f"{c} 0 n"], counts[f"{c} 1 n"]) for n, (C, c) in named.items()], "model string, c double, cutoff timestamp_ntz, n_train long, n_valid long")
    return facts.join(found.drop("n"), "model").select("c", "cutoff", "n_train", "n_valid", "average_precision")
