"""What a model relies on: importance by contributions and by permutation, refits without columns, stability of the ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.scalar import poisson
from ..operators.ordered import first_by
from .model_frames import known_at, known_at_flag
from .models import Fitted, average_precision_of, fit
from .together import Spec, fit_together, importance_together, precision_together, scored_together

#: Groups of columns whose worth is measured by leaving them out.
ABLATIONS = {
    "all": (),
    "no_assignee_open": ("assignee_open",),
    "no_reporter": ("reporter_prior_tickets", "reporter_first_time"),
    "no_history": ("peer_n", "peer_median_lead_days", "peer_late_rate", "project_median_lead_days", "project_late_rate"),
}
#: Rows that swap values among themselves in ``permutation_importance``.
BLOCK = 10_000


def importance(model: Fitted, frame: DataFrame, keys: list[str]) -> DataFrame:
    """(feature, mean_abs): the mean size of each feature's contribution; one row for each feature."""
    return model.contributions(frame, keys).groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))


def permutation_importance(model: Fitted, frame: DataFrame, key: str, features: list[str], label: str = "is_late", repeats: int = 3, seed: int = 0) -> DataFrame:
    """``permutation_drops`` of a fitted pipeline."""
    return permutation_drops(frame, model.score, key, features, label, repeats, seed)


def permutation_drops(frame: DataFrame, score: Callable[[DataFrame], DataFrame] | None, key: str, features: list[str], label: str = "is_late", repeats: int = 3, seed: int = 0) -> DataFrame:
    """(feature, drop, drop_deviation): how much average precision falls when a column's values are dealt anew; ``score`` adds the column score.

    Rows fall into random blocks of about BLOCK and swap values within theirs, by two independent orders of hashes, so
    no order over all rows is needed. All columns are scored in one pass. ``key`` must be unique. Where there is no model
    (``score`` is None) or no row, drops are null.
    """
    rows = frame.filter(F.col(label).isNotNull())
    n = rows.count() if score else 0
    if not score or not n:
        unknown = F.lit(None).cast("double")
        return frame.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, features))).alias("feature"), unknown.alias("drop"), unknown.alias("drop_deviation"))
    blocks = max(1, n // BLOCK)
    both = []
    for r in range(repeats):
        block = F.pmod(F.xxhash64(F.col(key), F.lit(f"block {seed} {r}")), F.lit(blocks)).alias("_block")
        order = lambda side: [F.xxhash64(F.col(key), F.lit(f"{side} {seed} {r}")), F.col(key)]  # noqa: B023, E731
        own = first_by(rows.select("*", block), ["_block"], order("own"), "_place")
        given = first_by(rows.select(key, F.struct(*features).alias("_given"), block), ["_block"], order("given"), "_place").drop(key)
        both.append(own.join(given, ["_block", "_place"]).drop("_block", "_place").withColumn("_repeat", F.lit(r)))
    dealt = both[0]
    for more in both[1:]:
        dealt = dealt.unionByName(more)
    each = dealt.withColumn("_feature", F.explode(F.array(*map(F.lit, features))))
    each = each.withColumns({f: F.when(F.col("_feature") == f, F.col(f"_given.{f}")).otherwise(F.col(f)) for f in features}).drop("_given")
    whole = average_precision_of(score(rows), label)
    counts = metrics.score_counts(score(each), label, "score", ["_feature", "_repeat"])
    found = counts.groupBy("_feature", "_repeat").agg(metrics.average_precision().alias("_dealt"))
    drop = F.lit(whole) - F.col("_dealt")
    return found.groupBy(F.col("_feature").alias("feature")).agg(F.avg(drop).alias("drop"), F.stddev_pop(drop).alias("drop_deviation"))


def ablations(kind: str, point: str, train: DataFrame, test: DataFrame, params: dict, groups: dict[str, tuple[str, ...]] = ABLATIONS, label: str = "is_late") -> list[dict]:
    """Average precision and ROC-AUC on ``test`` of models that do without each group of columns; logistic ones are fitted together."""
    if kind == "logistic":
        fitted = fit_together(train, point, [Spec(name, F.lit(1), params["C"], without) for name, without in groups.items()], label)
        models = [m for m in fitted if m is not None]
        rows = precision_together(scored_together(test, models), models, [F.lit(True)] * len(models), label).collect() if models else []
        found = {r["model"]: r for r in rows}
    else:
        found = {}
        for name, without in groups.items():
            scored = fit(kind, point, train, params, label, without).score(test)
            found[name] = metrics.score_counts(scored, label, "score").groupBy("_one").agg(metrics.average_precision().alias("average_precision"), metrics.roc_auc().alias("roc_auc")).first()
    return [{"name": name, **{m: found[name][m] if found.get(name) else None for m in ("average_precision", "roc_auc")}} for name in groups]


def resampled(train: DataFrame, key: str, replicate: int, seed: int = 0) -> DataFrame:
    """``train`` with each row as often as a Poisson draw from its key and the replicate."""
    times = poisson(F.xxhash64(F.col(key), F.lit(replicate), F.lit(seed)))
    return train.withColumn("_times", times).filter("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).drop("_times", "_copy")


def stability(model: Fitted, point: str, train: DataFrame, sample: DataFrame, params: dict, key: str, cutoffs: Iterable[datetime] = (), replicates: int = 5, seed: int = 0) -> list[dict]:
    """How the ranking of features moves in refits on resampled rows, and on what was known at earlier cutoffs.

    Each entry: what was refitted, Spearman's correlation with the model's ranking, common features of the first three.
    Only one number for each feature comes to the driver.
    """
    ranking = lambda m: {r["feature"]: r["mean_abs"] for r in importance(m, sample, [key]).collect()}
    reference = ranking(model)
    refits = [({"resample": i}, resampled(train, key, i, seed)) for i in range(replicates)]
    refits += [({"known_at": c}, known_at(train, c)) for c in cutoffs]
    out = []
    for name, rows in refits:
        out.append(name | compared(reference, ranking(fit(model.kind, point, rows, params))))
    return out


def stability_together(point: str, train: DataFrame, sample: DataFrame, C: float, key: str, cutoffs: Iterable[datetime] = (), replicates: int = 20, seed: int = 0, label: str = "is_late") -> list[dict]:
    """``stability`` of a logistic model: the model itself and all refits are fitted together, their importances taken in one pass.

    A refit whose rows lack a class has no model: its numbers are None, and so are all where the model itself has none.
    """
    named: dict[str, tuple[dict, Column]] = {f"resample {i}": ({"resample": i}, poisson(F.xxhash64(F.col(key), F.lit(i), F.lit(seed)))) for i in range(replicates)}
    named |= {f"known at {c}": ({"known_at": c}, known_at_flag(c).cast("int")) for c in cutoffs}
    fitted = fit_together(train, point, [Spec("", F.lit(1), C), *(Spec(n, w, C) for n, (_, w) in named.items())], label)
    sizes = importance_together(sample, [m for m in fitted if m is not None])
    none = {"spearman": None, "top3_overlap": None, "top3": None}
    return [facts | (compared(sizes[""], sizes[n]) if n in sizes and "" in sizes else none) for n, (facts, _) in named.items()]


def compared(reference: dict[str, float], found: dict[str, float]) -> dict:
    """How two rankings of features agree: Spearman's correlation, and the common features of the first three."""
    first = [sorted(r, key=lambda f: (-r[f], f))[:3] for r in (reference, found)]  # noqa: B023
    return {"spearman": spearman([(v, found.get(f, 0.0)) for f, v in reference.items()]), "top3_overlap": len({*first[0]} & {*first[1]}), "top3": first[1]}


def spearman(pairs: list[tuple[float, float]]) -> float | None:
    """Rank correlation, equal values sharing their mean rank; None where a side has one value only."""

    def ranks(values: list[float]) -> list[float]:
        return [sum(w < v for w in values) + (values.count(v) + 1) / 2 for v in values]

    a, b = ranks([x for x, _ in pairs]), ranks([y for _, y in pairs])
    middle = (len(pairs) + 1) / 2
    size = lambda x: sum((v - middle) ** 2 for v in x)
    if not pairs or not size(a) or not size(b):
        return None
    return sum((x - middle) * (y - middle) for x, y in zip(a, b, strict=True)) / (size(a) * size(b)) ** 0.5
