"""Language identification: each document is a mixture of languages, fitted by EM on its n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, hash_limit, keep_rows, small_table, text_bytes

#: N-grams are UTF-8 byte trigrams hashed into so many buckets, or fewer (halved, until the numbers of all languages are
#: at most MODEL_CELLS), so every language is learned and a model takes up to 64 MB. Under LEAST_BUCKETS there is no model.
BUCKETS, LEAST_BUCKETS, MODEL_CELLS = 1 << 16, 1 << 8, 1 << 24
#: Documents of each language that the model is learned from, about, at most (a hash of the id chooses them).
SAMPLE_PER_LANG = 4000
#: Added to every bucket's count.
SMOOTHING = 0.5
#: Neighbouring trigrams share bytes, so a likelihood counts a third; a language more must gain so many times log(n) / 2.
PENALTY = 4.0
EM_STEPS = 15
#: Bytes of a text that are counted at once.
PIECE = 1 << 20

#: ASCII letters stay, A-Z as a-z, other ASCII characters become blanks, bytes of other characters stay.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def buckets_for(langs: int, cells: int = MODEL_CELLS) -> int:
    """Buckets of a model of so many languages."""
    most = cells // max(1, langs)
    if most < LEAST_BUCKETS:
        raise ValueError(f"{langs} values of the language column: it can't hold languages")
    return min(BUCKETS, 1 << (most.bit_length() - 1))


def ngram_counts(text: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket's trigrams occur in the text's words; ``buckets`` is a power of two."""
    shift = np.uint32(33 - buckets.bit_length())
    squeezed = b" " + b" ".join(text.translate(_LETTERS).split()) + b" "
    count = np.zeros(buckets, np.int64)
    for at in range(0, len(squeezed), PIECE):
        codes = np.frombuffer(squeezed[at : at + PIECE + 2], np.uint8).astype(np.uint32)
        mixed = (codes[:-2] * np.uint32(0x9E3779B1)) ^ (codes[1:-1] * np.uint32(0x85EBCA77)) ^ (codes[2:] * np.uint32(0xC2B2AE3D))
        count += np.bincount(mixed >> shift, minlength=buckets)
    return count


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode()))


def _mixture(likelihood: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the languages (rows) and the log-likelihood, by expectation-maximisation."""
    share = np.full(len(likelihood), 1 / len(likelihood))
    total = count.sum()
    for _ in range(EM_STEPS if len(share) > 1 else 0):
        new = share * (likelihood @ (count / (share @ likelihood))) / total
        done = np.abs(new - share).max() < 1e-3
        share = new
        if done:
            break
    return share, float(count @ np.log(share @ likelihood))


def infer(text: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int, np.ndarray]:
    """Rows of ``table`` (languages x buckets) chosen for the text, their proportions, log-likelihood, number of n-grams, and the proportions of all rows.

    EM over all languages ranks them; the set grows along that ranking as long as the penalised likelihood does.
    """
    counts = ngram_counts(text, table.shape[1])
    some = np.flatnonzero(counts)
    count, likelihood = counts[some].astype(float), table[:, some].astype(float)
    total = int(counts.sum())
    among_all = _mixture(likelihood, count)[0]
    order = np.argsort(-among_all, kind="stable")
    best = (order[:1], *_mixture(likelihood[order[:1]], count))
    for size in range(2, len(order) + 1):
        chosen = order[:size]
        share, fit = _mixture(likelihood[chosen], count)
        if (fit - best[2]) / 3 <= PENALTY * np.log(total) / 2:
            break
        best = (chosen, share, fit)
    return *best, total, among_all


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_lang: int = SAMPLE_PER_LANG, cells: int = MODEL_CELLS) -> tuple[list[str], np.ndarray]:
    """The languages of the rows and their n-gram probabilities, from at most about ``sample_per_lang`` documents of each.

    Rows with a null text, language or id teach nothing. The model has one row of ``buckets_for`` numbers for each
    language; none is left out.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().limit(cells // LEAST_BUCKETS + 1).collect()}
    if not sizes:
        return [], np.empty((0, BUCKETS), np.float32)
    langs, buckets = sorted(sizes), buckets_for(len(sizes), cells)
    place = {lang: i for i, lang in enumerate(langs)}
    # at most MODEL_CELLS // LEAST_BUCKETS rows
    limits = small_table(spark, lang=pa.array(list(sizes), pa.string()), most=pa.array([hash_limit(n, sample_per_lang) for n in sizes.values()], pa.int64()))
    chosen = docs.join(F.broadcast(limits), "lang").filter(F.xxhash64("id") <= F.col("most")).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                sums[lang] = sums.get(lang, 0) + ngram_counts(text, buckets)
        for lang, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), place[lang], np.int32)), pa.array(some.astype(np.int32)), pa.array(n[some].astype(np.int64))], names=["lang", "bucket", "n"])

    rows = chosen.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((len(langs), buckets), SMOOTHING)
    table[rows["lang"].to_numpy(), rows["bucket"].to_numpy()] += rows["n"].to_numpy()
    return langs, (table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def verdict(text: bytes | None, langs: list[str], table: np.ndarray) -> tuple[str, float, str, bool]:
    """(lang_pred, score, languages, explained) of one text, as in ``predict``."""
    if not langs or text is None or not has_letter(text):
        return "und", 0.0, "", False
    chosen, share, fit, total, among_all = infer(text, table)
    rank = np.argsort(-share, kind="stable")
    names = [langs[chosen[i]] for i in rank]
    told = total / 3  # trigrams that tell something of their own
    score = (told * among_all[chosen[rank[0]]] + 1) / (told + len(langs))
    return names[0], min(1.0, float(score)), ",".join(names), fit > -total * np.log(table.shape[1])


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, languages, explained) of every row, from the whole text alone.

    ``lang_pred`` is the language of the largest proportion in the chosen set ``languages`` (comma-joined, largest
    first). ``score`` is its expected proportion among all languages, which are equally likely before: it is near
    1 / languages for a few letters, and below 1 the more, the more of the text other languages would explain. A text that is null or has no letter, or any text where no language was learned, gets ``und``, score 0 and
    no languages. ``explained`` is false for those, and where equally likely n-grams fit better than the languages do.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [verdict(text, langs, shared.value) for text in text_bytes(batch.column(1))]
            pred, score, sets, explained = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string()), pa.array(explained, pa.bool_())], names=["id", "lang_pred", "score", "languages", "explained"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double, languages string, explained boolean")


def keep_explained(docs: DataFrame, langs: list[str], table: np.ndarray, text_col: str = "text") -> DataFrame:
    """The rows whose text is ``explained`` by the learned languages, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    at = docs.columns.index(text_col)
    return keep_rows(docs, lambda batch: [verdict(text, langs, shared.value)[3] for text in text_bytes(batch.column(at))])


def held_out(id_col: str = "doc_id") -> F.Column:
    """True for the third of the documents that a model is measured on; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, then predict all: (doc_id, held_out, lang_pred, score, languages, explained).

    Repeated ids keep their rows, an empty table gives an empty one, other columns are ignored.
    """
    langs, table = learn(docs.filter(~held_out()))
    found = predict(docs, langs, table)
    return found.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score", "languages", "explained")
