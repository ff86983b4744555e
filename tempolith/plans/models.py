"""Models on feature rows: logistic regression and boosted trees, tuned on rolling folds, calibrated, compared, explained."""

from __future__ import annotations

import json
from collections.abc import Callable, Collection
from dataclasses import dataclass
from datetime import datetime

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.scalar import log1p_clipped, sigmoid
from ..operators.ordered import quantiles
from . import trees
from .isotonic import Isotonic
from .model_frames import feature_columns, folds, known_at, long_form
from .together import tune_together

LOGISTIC_GRID = ({"C": 0.03}, {"C": 0.3}, {"C": 3.0})
BOOSTING_GRID = ({"step": 0.1, "depth": 4}, {"step": 0.1, "depth": 5})
MIN_TRAIN, MIN_VALID = 200, 50


@dataclass(frozen=True)
class Numbers:
    """Medians that fill gaps, and mean and deviation of each numeric column after it; a few numbers, kept on the driver."""

    columns: tuple[str, ...]
    logged: frozenset[str]
    median: dict[str, float]
    mean: dict[str, float]
    deviation: dict[str, float]

    @classmethod
    def fit(cls, frame: DataFrame, point: str, without: Collection[str] = ()) -> Numbers:
        kinds = feature_columns(point)
        columns = [c for c in (*kinds["log"], *kinds["linear"]) if not (c == "has_assignee" and point == "creation") and c not in without]
        logged = frozenset(kinds["log"])
        long = long_form(frame, [], {c: F.col(c) for c in columns})
        medians = {r["feature"]: r["mid"] for r in quantiles(long, ["feature"], "value", {"mid": 0.5}).collect()}
        median = {c: medians.get(c, 0.0) for c in columns}
        own = cls(tuple(columns), logged, median, {}, {})
        stats = frame.agg(*(x for c in columns for x in (F.avg(own.filled(c)).alias(f"m_{c}"), F.stddev_pop(own.filled(c)).alias(f"s_{c}")))).first()
        return cls(tuple(columns), logged, median, {c: stats[f"m_{c}"] or 0.0 for c in columns}, {c: stats[f"s_{c}"] or 1.0 for c in columns})

    def filled(self, c: str) -> F.Column:
        value = F.coalesce(F.col(c).cast("double"), F.lit(self.median[c]))
        return log1p_clipped(value) if c in self.logged else value

    def scaled(self, frame: DataFrame) -> DataFrame:
        """``frame`` with z_<column> and gap_<column>; no nulls are left."""
        z = {f"z_{c}": (self.filled(c) - self.mean[c]) / self.deviation[c] for c in self.columns}
        return frame.withColumns(z | {f"gap_{c}": F.col(c).isNull().cast("double") for c in self.columns})


@dataclass(frozen=True)
class Fitted:
    kind: str
    numbers: Numbers
    pipeline: Model

    def _log_odds(self, frame: DataFrame) -> DataFrame:
        """``frame`` scaled, with _v, its vector as an array, and _raw, its log-odds."""
        *steps, last = self.pipeline.stages
        if self.kind == "boosting":
            return self.pipeline.transform(self.numbers.scaled(frame)).withColumns({"_v": vector_to_array("features"), "_raw": vector_to_array("rawPrediction")[1]})
        # by its weights: a fitted logistic stage holds its session, which is not always serializable
        rows = PipelineModel(steps).transform(self.numbers.scaled(frame)).withColumn("_v", vector_to_array("features"))
        weights = F.array(*(F.lit(float(w)) for w in last.coefficients.toArray()))
        return rows.withColumn("_raw", F.aggregate(F.zip_with("_v", weights, lambda x, w: x * w), F.lit(float(last.intercept)), lambda a, b: a + b))

    def score(self, frame: DataFrame) -> DataFrame:
        """``frame`` with score, the chance of being late."""
        chance = vector_to_array("probability")[1] if self.kind == "boosting" else sigmoid(F.col("_raw"))
        return self._log_odds(frame).withColumn("score", chance).select(*frame.columns, "score")

    def origins(self) -> list[str]:
        """For each place of the feature vector, the column that it comes from."""
        names = [c for c in self.numbers.columns for _ in range(2)]
        for stage in self.pipeline.stages:
            if hasattr(stage, "labelsArray"):
                for c, labels in zip(stage.getInputCols(), stage.labelsArray, strict=True):
                    names += [c] * (len(labels) + 1)
        return names

    def contributions(self, frame: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, feature, contribution): exact additive parts of the log-odds, which add up to them less ``base``.

        Of a logistic model each weight times its value, of boosted trees the Shapley values over the trees' own covers.
        One-hot and gap columns count for the column they come from.
        """
        scored = self._log_odds(frame).select(*keys, "_v", "_raw")
        if self.kind == "boosting":
            return trees.contributions(scored, keys, trees.leaves(self.pipeline.stages[-1]), self.origins())
        weights = self.pipeline.stages[-1].coefficients.toArray()
        named = F.array(*(F.struct(F.lit(n).alias("feature"), F.lit(float(w)).alias("weight")) for n, w in zip(self.origins(), weights, strict=True)))
        parts = F.zip_with(named, "_v", lambda a, b: F.struct(a["feature"].alias("feature"), (a["weight"] * b).alias("part")))
        rows = scored.select(*keys, F.explode(parts).alias("_p"))
        return rows.groupBy(*keys, F.col("_p.feature").alias("feature")).agg(F.sum("_p.part").alias("contribution"))

    def base(self) -> float:
        """The log-odds that contributions start from: the intercept, or the trees' mean over their training rows."""
        last = self.pipeline.stages[-1]
        return trees.mean(trees.leaves(last)) if self.kind == "boosting" else last.intercept


def fit(kind: str, point: str, train: DataFrame, params: dict, label: str = "is_late", without: Collection[str] = ()) -> Fitted:
    """A model of what was known; ``params`` has C, or step and depth. Columns in ``without`` are not used."""
    train = train.withColumn("_y", F.col(label).cast("double"))
    numbers = Numbers.fit(train, point, without)
    categories = [c for c in feature_columns(point)["categorical"] if c not in without]
    steps = [
        StringIndexer(inputCols=categories, outputCols=[f"i_{c}" for c in categories], handleInvalid="keep"),
        OneHotEncoder(inputCols=[f"i_{c}" for c in categories], outputCols=[f"o_{c}" for c in categories], dropLast=False),
        VectorAssembler(inputCols=[x for c in numbers.columns for x in (f"z_{c}", f"gap_{c}")] + [f"o_{c}" for c in categories], outputCol="features"),
    ]
    if kind == "logistic":
        steps.append(LogisticRegression(labelCol="_y", regParam=1 / (params["C"] * max(1, train.count())), standardization=False, maxIter=200))
    else:
        # a tenth, chosen by a hash of the values, only says when to stop
        train = train.withColumn("_held", F.pmod(F.xxhash64(*numbers.columns, *categories), F.lit(10)) == 0)
        steps.append(GBTClassifier(labelCol="_y", stepSize=params["step"], maxDepth=params["depth"], maxIter=params.get("rounds", 40), seed=0, validationIndicatorCol="_held"))
    return Fitted(kind, numbers, Pipeline(stages=steps).fit(numbers.scaled(train)))


def save(model: Fitted, path: str) -> None:
    """Write a model: its pipeline, and beside it the numbers that scale its columns, as one JSON row."""
    n = model.numbers
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    row = json.dumps({"kind": model.kind, "columns": n.columns, "logged": sorted(n.logged), "median": n.median, "mean": n.mean, "deviation": n.deviation})
    SparkSession.active().createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/numbers")


def load(spark: SparkSession, path: str) -> Fitted:
    """A model that ``save`` wrote."""
    x = json.loads(spark.read.text(f"{path}/numbers").first()[0])
    numbers = Numbers(tuple(x["columns"]), frozenset(x["logged"]), x["median"], x["mean"], x["deviation"])
    return Fitted(x["kind"], numbers, PipelineModel.load(f"{path}/pipeline"))


def write_predictions(scored: DataFrame, path: str, keys: tuple[str, ...] = ("issue_key", "point"), scores: tuple[str, ...] = ("score",)) -> None:
    """Keys, outcome and scores as Parquet."""
    scored.select(*keys, "is_late", *scores).write.mode("overwrite").parquet(path)


def average_precision_of(scored: DataFrame, label: str = "is_late", score: str = "score") -> float | None:
    return metrics.score_counts(scored, label, score).groupBy("_one").agg(metrics.average_precision().alias("ap")).agg(F.max("ap")).first()[0]


def tune(kind: str, point: str, frame: DataFrame, cutoffs: tuple[datetime, ...], grid: tuple[dict, ...] | None = None) -> tuple[dict, list[dict]]:
    """The parameters of the best mean average precision over the folds; folds too small or of one class are left out.

    Logistic models of the whole grid and all folds are fitted together.
    """
    grid = grid or (LOGISTIC_GRID if kind == "logistic" else BOOSTING_GRID)
    if kind == "logistic":
        rows = tune_together(point, frame, cutoffs, [p["C"] for p in grid], MIN_TRAIN, MIN_VALID).orderBy("cutoff").collect()
        scores = [[r["average_precision"] for r in rows if r["c"] == p["C"]] for p in grid]
    else:
        scores = [[] for _ in grid]
        for _, train, valid in folds(frame, cutoffs):
            sizes = [d.agg(F.count("*"), F.count_distinct("is_late")).first() for d in (train, valid)]
            if sizes[0][0] >= MIN_TRAIN and sizes[1][0] >= MIN_VALID and min(s[1] for s in sizes) == 2:
                for own, params in zip(scores, grid, strict=True):
                    own.append(average_precision_of(fit(kind, point, train, params).score(valid)))
    found = [{"params": p, "mean": sum(s) / len(s) if s else float("-inf"), "folds": s} for p, s in zip(grid, scores, strict=True)]
    return max(found, key=lambda f: f["mean"])["params"], found


def fit_calibrated(kind: str, point: str, frame: DataFrame, params: dict, cutoff: datetime, cutoffs: tuple[datetime, ...]) -> tuple[Fitted, Callable[[DataFrame], DataFrame]]:
    """The final model, and a function that adds ``calibrated``: an isotonic map from the last fold, which saw nothing later."""
    model = fit(kind, point, known_at(frame, cutoff), params)
    *_, (_, train, valid) = folds(frame, cutoffs)
    scored = fit(kind, point, train, params).score(valid).withColumn("_y", F.col("is_late").cast("double"))
    fitted = Isotonic.fit(scored, "_y", "score")
    return model, lambda rows: fitted.apply(rows, "score")
