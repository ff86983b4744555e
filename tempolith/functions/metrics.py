"""Model metrics as aggregates: each works on (y, score) columns of any number of rows, for each group of ``keys``.

Scores are counted first; what needs an order goes along slices of the scores, so no task needs all rows of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import _null_safe

#: Slices into which scores between 0 and 1 fall.
SLICES = 256


def score_counts(df: DataFrame, y: str, score: str, keys: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """(keys, score, _n, _pos, _n_above, _pos_above, _n_all, _pos_all) of each distinct score; null labels and scores are left out.

    A row counts as often as its ``weight`` says, else once.
    """
    times = F.lit(1) if weight is None else weight
    keys = keys or ["_one"]
    rows = df if keys != ["_one"] else df.withColumn("_one", F.lit(1))
    rows = rows.filter(F.col(y).isNotNull() & F.col(score).isNotNull())
    each = rows.groupBy(*keys, F.col(score).alias("_s")).agg(F.sum(times).alias("_n"), F.sum(times * F.col(y).cast("int")).alias("_pos")).withColumn("_slice", F.floor(F.col("_s") * SLICES))
    sums = each.groupBy(*keys, "_slice").agg(F.sum("_n").alias("_sn"), F.sum("_pos").alias("_sp"))
    at = Window.partitionBy(*keys)
    down = at.orderBy(F.col("_slice").desc())
    sums = sums.select(*keys, "_slice", (F.sum("_sn").over(down) - F.col("_sn")).alias("_bn"), (F.sum("_sp").over(down) - F.col("_sp")).alias("_bp"), F.sum("_sn").over(at).alias("_n_all"), F.sum("_sp").over(at).alias("_pos_all"))
    joined = each.alias("e").join(sums.alias("t"), _null_safe([*keys, "_slice"], "e", "t")).select("e.*", "t._bn", "t._bp", "t._n_all", "t._pos_all")
    within = Window.partitionBy(*keys, "_slice").orderBy(F.col("_s").desc())
    above = lambda n, before: F.col(before) + F.sum(n).over(within) - F.col(n)
    return joined.withColumn("_n_above", above("_n", "_bn")).withColumn("_pos_above", above("_pos", "_bp"))


def average_precision() -> Column:
    """Over ``score_counts``: the mean precision at each positive, ties taken together."""
    precision = (F.col("_pos_above") + F.col("_pos")) / (F.col("_n_above") + F.col("_n"))
    return F.try_divide(F.sum(F.col("_pos") * precision), F.max("_pos_all"))


def roc_auc() -> Column:
    """Over ``score_counts``: how often a positive scores above a negative, a tie counting half; null with one class."""
    negatives = F.col("_n") - F.col("_pos")
    below = (F.col("_n_all") - F.col("_pos_all")) - (F.col("_n_above") - F.col("_pos_above")) - negatives
    pairs = F.max("_pos_all") * (F.max("_n_all") - F.max("_pos_all"))
    return F.try_divide(F.sum(F.col("_pos") * (below + 0.5 * negatives)), pairs)


def _clipped(score: str) -> Column:
    return F.least(F.greatest(F.col(score), F.lit(1e-6)), F.lit(1 - 1e-6))


def brier(y: str, score: str) -> Column:
    return F.avg(F.pow(_clipped(score) - F.col(y).cast("double"), F.lit(2.0)))


def log_loss(y: str, score: str) -> Column:
    p = _clipped(score)
    return -F.avg(F.when(F.col(y).cast("int") == 1, F.log(p)).otherwise(F.log(1 - p)))


def top_fraction(df: DataFrame, y: str, score: str, tie: Column, keys: list[str] | None = None, share: float = 0.1) -> DataFrame:
    """(keys, k, precision, recall, lift) of the ``share`` of rows with the highest scores, ties in the order of ``tie``.

    Only the one score at which the share ends needs an order among its rows.
    """
    keys = keys or ["_one"]
    rows = (df if keys != ["_one"] else df.withColumn("_one", F.lit(1))).filter(F.col(y).isNotNull() & F.col(score).isNotNull())
    counts = score_counts(rows, y, score, keys).withColumn("_k", F.greatest(F.ceil(share * F.col("_n_all")), F.lit(1)))
    whole = counts.filter(F.col("_n_above") + F.col("_n") <= F.col("_k")).groupBy(*keys).agg(F.sum("_pos").alias("_hits"))
    edge = counts.filter((F.col("_n_above") < F.col("_k")) & (F.col("_n_above") + F.col("_n") > F.col("_k"))).select(*keys, "_s", (F.col("_k") - F.col("_n_above")).alias("_room"))
    cut = _null_safe(keys, "r", "e") & (F.col(f"r.{score}") == F.col("e._s"))
    last = rows.withColumn("_tie", tie).alias("r").join(edge.alias("e"), cut).select("r.*", "e._room")
    last = last.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_tie"))).filter("_rank <= _room").groupBy(*keys).agg(F.sum(F.col(y).cast("int")).alias("_more"))
    sizes = counts.groupBy(*keys).agg(F.max("_k").alias("k"), F.max("_n_all").alias("_n"), F.max("_pos_all").alias("_p"))
    out = sizes
    for part in (whole, last):
        out = out.join(part, keys, "left")
    hits = F.coalesce("_hits", F.lit(0)) + F.coalesce("_more", F.lit(0))
    precision = hits / F.col("k")
    found = out.select(*keys, "k", precision.alias("precision"), (hits / F.greatest(F.col("_p"), F.lit(1))).alias("recall"), F.when(F.col("_p") > 0, precision / (F.col("_p") / F.col("_n"))).alias("lift"))
    return found.drop("_one")


def calibration_table(df: DataFrame, y: str, score: str, tie: str, bins: int = 10) -> DataFrame:
    """(bin, predicted, observed, n): rows in order of (score, tie), cut into bins of equal numbers, the lower ones closed above."""
    rows = df.filter(F.col(y).isNotNull() & F.col(score).isNotNull()).select(F.col(y).cast("int").alias("_y"), F.col(score).alias("_s"), F.col(tie).alias("_tie")).withColumn("_slice", F.floor(F.least(F.greatest(F.col("_s"), F.lit(0.0)), F.lit(1.0)) * SLICES))
    sums = rows.groupBy("_slice").agg(F.count("*").alias("_c"))
    # at most SLICES + 1 rows, whatever the scores
    before = sums.withColumn("_before", F.sum("_c").over(Window.orderBy("_slice")) - F.col("_c")).withColumn("_all", F.sum("_c").over(Window.partitionBy())).drop("_c")
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_slice").orderBy("_s", "_tie"))
    numbered = rows.join(F.broadcast(before), "_slice").withColumn("_rank", rank)
    place = F.ceil((F.col("_rank") - 1) * bins / F.greatest(F.col("_all") - 1, F.lit(1))) - 1
    cut = numbered.withColumn("bin", F.greatest(place, F.lit(0)).cast("int"))
    mean = lambda c: F.round(F.avg(c) * 10_000) / 10_000
    return cut.groupBy("bin").agg(mean("_s").alias("predicted"), mean("_y").alias("observed"), F.count("*").alias("n"))
