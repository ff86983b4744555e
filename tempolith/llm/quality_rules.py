"""Quality rules: text statistics, then robust outliers among them, with DataFrame functions only.

The statistics of a group (language and source) are centred and scaled by its minimum-covariance-determinant estimate,
and a document whose squared Mahalanobis distance is too large is rejected.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import settle

#: The share of a group that the estimate rests on: half, so that it stands with nearly half of the rows outlying.
CORE = 0.5
#: Groups with fewer rows are judged by their whole language, and languages with fewer by all rows.
MIN_ROWS = 100
#: Concentration steps.
STEPS = 4
#: Squared distances are told apart by bins, so many to a doubling.
BINS_PER_OCTAVE = 16
#: A document is rejected beyond this quantile of the chi-squared distribution, times SLACK for heavy tails.
QUANTILE, SLACK = 0.999, 3.0
#: Least standard deviation of each statistic, in the order of ``vector``; most texts have none of some things at all.
FLOORS = (0.35, 0.10, 0.35, 0.50, 0.50, 0.35)

_SPACE = r"[\x20\x09-\x0D]+"


def chi2_quantile(p: float, k: int) -> float:
    """Wilson and Hilferty's approximation."""
    return k * (1 - 2 / (9 * k) + NormalDist().inv_cdf(p) * (2 / (9 * k)) ** 0.5) ** 3


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper (long) in place of the text; null counts as empty.

    Repeated windows are told by XXH64 of their three words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("_text", text).drop(text_col)
    df = df.withColumn("_words", F.array_remove(F.split("_text", _SPACE), "")).withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.select(
        *(c for c in docs.columns if c != text_col),
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_text", r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda x, i: F.xxhash64(x, F.get("_words", i + 1), F.get("_words", i + 2))).alias("_windows"),
    )
    df = df.withColumn("_windows", F.slice("_windows", 1, F.greatest(F.size("_windows") - 2, F.lit(0))))
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("p")))))).drop("_windows")
    same = lambda x, i: (F.get("_sorted", i - 1)["h"].eqNullSafe(x["h"])) | (F.get("_sorted", i + 1)["h"].eqNullSafe(x["h"]))
    df = df.withColumn("_places", F.sort_array(F.transform(F.filter("_sorted", same), lambda x: x["p"]))).drop("_sorted")
    covered = F.aggregate(F.transform("_places", lambda p, i: F.least(F.lit(3), F.get("_places", i + 1) - p)), F.lit(0), lambda a, b: a + b)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_places")


def vector() -> list[F.Column]:
    """The statistics as numbers of about normal distribution, for texts with words."""
    per_word = lambda c: F.log1p(100.0 * F.col(c) / F.col("n_words"))
    return [
        F.log1p(F.col("n_words").cast("double")),
        F.log(F.col("word_chars") / F.col("n_words")),
        per_word("n_symbols"),
        F.log1p(F.col("n_dup_lines").cast("double")),
        per_word("n_repeat_words"),
        per_word("n_upper"),
    ]


def _pooled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with ``level``, ``a`` and ``b``, the group that judges each: language and source, else the whole language, else all.

    The second table maps each language and source to every group that its rows help to estimate: larger groups count
    whole, but only those are estimated that judge something.
    """
    counted = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    own = F.col("n") >= MIN_ROWS
    counted = counted.withColumn("level", F.when(own, 0).when(F.sum("n").over(Window.partitionBy("lang")) >= MIN_ROWS, 1).otherwise(2))
    counted = settle(counted.withColumn("lang_judges", F.max(F.col("level") == 1).over(Window.partitionBy("lang"))), "groups")
    # one row, from an aggregate without keys
    needed = counted.join(F.broadcast(counted.agg(F.coalesce(F.max(F.col("level") == 2), F.lit(False)).alias("all_judge"))))
    levels = F.filter(F.array(F.when(F.col("level") == 0, 0), F.when(F.col("lang_judges"), 1), F.when(F.col("all_judge"), 2)), lambda x: x.isNotNull())
    helps = _named(needed.select("lang", "source", F.explode(levels).alias("level")))
    judged_by = counted.select("lang", "source", "level")
    return _named(_of_source(rows, judged_by)), helps


def _of_source(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with the other columns of ``groups`` that have their language and source."""
    joined = rows.alias("r").join(groups.alias("g"), F.col("r.lang").eqNullSafe(F.col("g.lang")) & F.col("r.source").eqNullSafe(F.col("g.source")))
    return joined.select("r.*", *(F.col(f"g.{c}") for c in groups.columns if c not in ("lang", "source")))


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("a", F.when(F.col("level") < 2, F.col("lang"))).withColumn("b", F.when(F.col("level") < 1, F.col("source")))


def _group(left: str, right: str) -> F.Column:
    return (F.col(f"{left}.level") == F.col(f"{right}.level")) & F.col(f"{left}.a").eqNullSafe(F.col(f"{right}.a")) & F.col(f"{left}.b").eqNullSafe(F.col(f"{right}.b"))


def _histogram(rows: DataFrame, dims: int) -> DataFrame:
    """Counts of each statistic's values in steps of 1/64, with the counts up to and over all of them."""
    tall = rows.select("level", "a", "b", F.posexplode(F.array(*(F.floor(F.col(f"x{j}") * 64) for j in range(dims)))).alias("dim", "bin"))
    bins = tall.groupBy("level", "a", "b", "dim", "bin").agg(F.count("*").alias("n"))
    at = Window.partitionBy("level", "a", "b", "dim")
    return bins.withColumn("upto", F.sum("n").over(at.orderBy("bin"))).withColumn("all", F.sum("n").over(at))


def _diagonal(wide: DataFrame, dims: int, spread) -> DataFrame:
    """The estimate with centres ``m0``... of ``wide`` and deviations ``spread(j)``, none below its floor."""
    lower = [F.lit(0.0).alias(f"l{i}_{j}") if i != j else F.greatest(spread(j), F.lit(FLOORS[j])).alias(f"l{i}_{j}") for i in range(dims) for j in range(i + 1)]
    return wide.select("level", "a", "b", *(f"m{j}" for j in range(dims)), *lower)


def _first_estimate(rows: DataFrame, dims: int) -> DataFrame:
    """Medians and quartile ranges of each group, from histograms: counts that add up, whatever the order."""
    bins = _histogram(rows, dims)
    wide = bins.groupBy("level", "a", "b").agg(*(x for j in range(dims) for x in _quartiles(bins, j)))
    return _diagonal(wide, dims, lambda j: (F.col(f"hi{j}") - F.col(f"lo{j}")) / 1.349)


def _starts(rows: DataFrame, dims: int) -> list[DataFrame]:
    """Estimates to start from: medians with quartile ranges, medians with the floors, and middles of shortest halves with their lengths."""
    bins = settle(_histogram(rows, dims), "histogram")
    wide = bins.groupBy("level", "a", "b").agg(*(x for j in range(dims) for x in _quartiles(bins, j)))
    # the half that starts with a bin ends where the count has grown by half: both are places in the order of counts
    at = Window.partitionBy("level", "a", "b", "dim")
    ends = bins.select("level", "a", "b", "dim", "bin", F.col("upto").alias("place"), F.lit(True).alias("end"))
    begins = bins.filter(F.col("upto") - F.col("n") <= F.col("all") / 2).select("level", "a", "b", "dim", "bin", (F.col("upto") - F.col("n") + F.ceil(F.col("all") / 2)).alias("place"), F.lit(False).alias("end"))
    met = ends.unionByName(begins).withColumn("last", F.min(F.when(F.col("end"), F.col("bin"))).over(at.orderBy(F.desc("place")).rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    half = met.filter("not end and last is not null").groupBy("level", "a", "b", "dim").agg(F.min(F.struct((F.col("last") - F.col("bin")).alias("length"), "bin")).alias("half"))
    pick = lambda j, c: F.min(F.when(F.col("dim") == j, c))
    length, middle = (F.col("half.length") + 1.0) / 64, (F.col("half.bin") + (F.col("half.length") + 1.0) / 2) / 64
    halves = half.groupBy("level", "a", "b").agg(*(x for j in range(dims) for x in (pick(j, middle).alias(f"m{j}"), pick(j, length).alias(f"w{j}"))))
    return [
        _diagonal(wide, dims, lambda j: (F.col(f"hi{j}") - F.col(f"lo{j}")) / 1.349),
        _diagonal(wide, dims, lambda j: F.lit(FLOORS[j])),
        _diagonal(halves, dims, lambda j: F.col(f"w{j}") / 1.349),
    ]


def _quartiles(bins: DataFrame, j: int) -> list[F.Column]:
    edge = lambda q: F.min(F.when((F.col("dim") == j) & (F.col("upto") >= q * F.col("all")), (F.col("bin") + 0.5) / 64))
    return [edge(0.25).alias(f"lo{j}"), edge(0.5).alias(f"m{j}"), edge(0.75).alias(f"hi{j}")]


def estimates(rows: DataFrame, dims: int, steps: int = STEPS) -> DataFrame:
    """Each group's estimate of least determinant among those that the starts lead to; the earlier of equal ones.

    All starts take a step in one pass: a start's rows are groups of their own, told by tens of ``level``.
    """
    starts = _starts(rows, dims)
    shift = lambda df, number: df.withColumn("level", (F.col("level") + 10 * number).cast("int"))
    estimate = shift(starts[0], 0)
    for number, start in enumerate(starts[1:], 1):
        estimate = estimate.unionByName(shift(start, number))
    each = shift(rows.withColumn("start", F.explode(F.array(*map(F.lit, range(len(starts)))))), F.col("start")).drop("start")
    estimate = settle(estimate, "estimate")
    for _ in range(steps):
        estimate = settle(_concentrate(each, estimate, dims), "estimate")
    size = sum((F.log(F.col(f"l{i}_{i}")) for i in range(dims)), F.lit(0.0))
    best = Window.partitionBy("level", "a", "b").orderBy("size", "start")
    estimate = estimate.withColumn("size", size).withColumn("start", F.floor(F.col("level") / 10)).withColumn("level", (F.col("level") % 10).cast("int"))
    return settle(estimate.withColumn("place", F.row_number().over(best)).filter("place = 1").drop("place", "size", "start"), "estimate")


def _distances(rows: DataFrame, estimate: DataFrame, dims: int) -> DataFrame:
    """Rows with ``d2``, by forward substitution with the group's Cholesky factor."""
    df = rows.alias("r").join(estimate.alias("e"), _group("r", "e"), "left").select("r.*", *(F.col(f"e.{c}").alias(c) for c in estimate.columns if c not in ("level", "a", "b")))
    for i in range(dims):
        known = sum((F.col(f"l{i}_{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))
        df = df.withColumn(f"z{i}", (F.col(f"x{i}") - F.col(f"m{i}") - known) / F.col(f"l{i}_{i}"))
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(dims)), F.lit(0.0))
    return df.select(*rows.columns, d2.alias("d2"))


def _concentrate(rows: DataFrame, estimate: DataFrame, dims: int) -> DataFrame:
    """One C-step: mean and covariance of the CORE of each group that is nearest by the estimate.

    Each bin of distances keeps its count, sums and products, so one pass and a small shuffle do; the core ends at a bin's edge.
    """
    pairs = [(i, j) for i in range(dims) for j in range(i + 1)]
    near = _distances(rows, estimate, dims).withColumn("bin", F.floor(F.log2(F.col("d2") + 2.0**-10) * BINS_PER_OCTAVE))
    bins = near.groupBy("level", "a", "b", "bin").agg(F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(dims)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs))
    at = Window.partitionBy("level", "a", "b")
    bins = bins.withColumn("upto", F.sum("n").over(at.orderBy("bin"))).withColumn("all", F.sum("n").over(at))
    core = bins.filter(F.col("upto") - F.col("n") < CORE * F.col("all"))
    sums = core.groupBy("level", "a", "b").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(dims)), *(F.sum(f"p{i}_{j}").alias(f"p{i}_{j}") for i, j in pairs))
    # the core is narrower than its group: its covariance is widened to what it would be under normal rows
    widen = CORE / _chi2_cdf(chi2_quantile(CORE, dims), dims + 2)
    df = sums.select("level", "a", "b", *((F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(dims)), "n", *(f"p{i}_{j}" for i, j in pairs))
    cov = lambda i, j: (F.col(f"p{i}_{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * widen + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))
    df = df.select("level", "a", "b", *(f"m{i}" for i in range(dims)), *(cov(i, j).alias(f"c{i}_{j}") for i, j in pairs))
    for i, j in pairs:  # Cholesky, entry by entry
        left = F.col(f"c{i}_{j}") - sum((F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(left, F.lit(1e-12))) if i == j else left / F.col(f"l{j}_{j}"))
    return df.select("level", "a", "b", *(f"m{i}" for i in range(dims)), *(f"l{i}_{j}" for i, j in pairs))


def _chi2_cdf(x: float, k: int) -> float:
    return NormalDist().cdf(((x / k) ** (1 / 3) - 1 + 2 / (9 * k)) / (2 / (9 * k)) ** 0.5)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", steps: int = STEPS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2) of every row.

    ``base_failed``: under 50 words, or more than half of them in repeated windows. The rest are compared within their
    language and source (null is a value like another); a group with under MIN_ROWS rows is judged by its whole
    language, and by all rows if that has too few as well, however many there are. Null texts count as empty,
    repeated ids keep their rows, an empty table gives an empty one, other columns are ignored.
    """
    dims = len(FLOORS)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"), "lang", "source")
    rows = settle(statistics(rows, "_t"), "statistics")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    good = rows.filter(~F.col("base_failed"))
    grouped, helps = _pooled(good)
    for i, x in enumerate(vector()):
        grouped = grouped.withColumn(f"x{i}", x)
    grouped = settle(grouped, "vectors")
    used = _of_source(grouped.select("lang", "source", *(f"x{i}" for i in range(dims))), helps).drop("lang", "source")
    judged = _distances(grouped, estimates(used, dims, steps), dims)
    limit = SLACK * chi2_quantile(QUANTILE, dims)
    shown = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = judged.select(*shown, F.coalesce(F.col("d2") <= limit, F.lit(True)).alias("kept"), F.col("d2").alias("distance2"))
    return judged.unionByName(rows.filter("base_failed").select(*shown, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance2")))
