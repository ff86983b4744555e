"""How filters overlap: fingerprint-routed chains find repeated texts, mask counts of each part answer for every order of the filters."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import permutations
from math import factorial

import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The filters, in the order of their bits in a mask of failed ones.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PCT, MAX_CAPITALS_PCT = 100, 80, 10
REPEATED = 1 << FILTERS.index("E")
#: Bytes of distinct texts that a task gathers before it sends their chains on; whatever the limit, the results are the same.
CHAIN_BYTES = 32 << 20
#: Bytes of texts, copies included, for which there is one partition of fingerprints.
ROUTED_BYTES = 64 << 20

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_SIGNS = b"#$%&*|"
_FOLLOWERS = bytes(range(0x80, 0xC0))

#: What is known of some rows of one id and text: how many there are of each (part, mask).
Facts = Counter
Row = tuple[int | None, str, int, int]


def failed(text: bytes) -> int:
    """The mask of A to D; ``split`` cuts at \\x20 and \\x09 to \\x0D."""
    words = text.split()
    chars = len(text.translate(None, _FOLLOWERS))
    fails = (
        len(words) < MIN_WORDS,
        100 * len(set(words)) < MIN_DISTINCT_PCT * len(words),
        100 * (len(text) - len(text.translate(None, _CAPITALS))) > MAX_CAPITALS_PCT * chars,
        len(text.translate(None, _SIGNS)) < len(text),
    )
    return sum(f << bit for bit, f in enumerate(fails))


class Chains:
    """Texts by fingerprint. A fingerprint's chain has [whole text, least id, facts of the rows with that id]; others leave as repeated."""

    def __init__(self) -> None:
        self.chains: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, key: int, text: bytes, doc_id: int, facts: Facts) -> tuple[int, Facts] | None:
        """Take in rows of one id; what is returned, if anything, are rows that have the same text as a smaller id."""
        chain = self.chains.setdefault(key, [])
        for entry in chain:
            if entry[0] == text:
                if doc_id == entry[1]:
                    entry[2] += facts
                    return None
                if doc_id > entry[1]:
                    return doc_id, facts
                later = entry[1], entry[2]
                entry[1:] = doc_id, facts
                return later
        chain.append([text, doc_id, facts])
        self.bytes += len(text)
        return None

    def drain(self) -> Iterator[tuple[int, bytes, int, Facts]]:
        for key, chain in self.chains.items():
            for text, doc_id, facts in chain:
                yield key, text, doc_id, facts
        self.chains, self.bytes = {}, 0


def _key_of(doc_id: int | None) -> int:
    return xxhash.xxh64_intdigest(str(doc_id).encode(), 1)


def _gathered(chain_bytes: int):
    """(key, (text, id, facts)) of a task's distinct texts, keyed by fingerprint, and (key, (None, id, facts)) of what is settled already."""

    def run(rows: Iterator) -> Iterator[tuple[int, tuple]]:
        own = Chains()
        for doc_id, text, lang in rows:
            raw = (text or "").encode()
            facts = Facts({(lang or "", failed(raw)): 1})
            if doc_id is None:
                yield _key_of(xxhash.xxh64_intdigest(raw)), (None, None, facts)
                continue
            later = own.add(xxhash.xxh64_intdigest(raw, 42), raw, doc_id, facts)
            if later:
                yield _key_of(later[0]), (None, later[0], _repeated(later[1]))
            if own.bytes > chain_bytes:
                yield from ((key, tuple(entry)) for key, *entry in own.drain())
        yield from ((key, tuple(entry)) for key, *entry in own.drain())

    return run


def _repeated(facts: Facts) -> Facts:
    return Facts({(part, mask | REPEATED): n for (part, mask), n in facts.items()})


def _resolved(rows: Iterable[tuple[int, tuple]]) -> Iterator[Row]:
    """The rows of one partition of fingerprints, each id once for each part and mask: those of the least id of a text last."""
    own = Chains()
    for key, (text, doc_id, facts) in rows:
        if text is not None:
            later = own.add(key, text, doc_id, facts)
            if later is None:
                continue
            doc_id, facts = later[0], _repeated(later[1])
        yield from ((doc_id, part, mask, n) for (part, mask), n in facts.items())
    for _, _, doc_id, facts in own.drain():
        yield from ((doc_id, part, mask, n) for (part, mask), n in facts.items())


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", chain_bytes: int = CHAIN_BYTES) -> RDD[Row]:
    """(id, part, mask of failed filters, rows) of all documents.

    Each task gathers its distinct texts first, so a text goes on once from each task however many copies it has; texts
    are then routed by fingerprint, and equal fingerprints are told apart by the whole text. A lost executor costs its
    tasks alone: nothing is kept outside the shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col), F.col(part_col).cast("string"))
    # partitions by what the texts hold, not by how well their files are compressed
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    spread = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // ROUTED_BYTES))
    routed = rows.rdd.mapPartitions(_gathered(chain_bytes)).partitionBy(spread, lambda key: key)
    return routed.mapPartitions(_resolved, preservesPartitioning=False)


def repeated_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> RDD[int]:
    """The ids, once each, of rows whose text a smaller id has as well."""
    return masks(docs.withColumn("_no_part", F.lit("")), id_col, text_col, "_no_part").filter(lambda r: r[2] & REPEATED).map(lambda r: r[0]).distinct()


def flagged(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, good, toxic): what any of an id's labels says."""
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    return labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))


Vector = list[int]
_SIZE = 1 << len(FILTERS)


def _counted(vector: Vector, row: tuple[int, int, bool, bool]) -> Vector:
    """A vector has, for each mask, the documents, the good ones and the toxic ones."""
    mask, n, good, toxic = row
    vector[mask] += n
    vector[_SIZE + mask] += n * good
    vector[2 * _SIZE + mask] += n * toxic
    return vector


def audit_part(part: str, vector: Vector) -> Iterator[tuple]:
    """The rows of one part: every order of the filters, step by step."""
    n, good, toxic = vector[:_SIZE], vector[_SIZE : 2 * _SIZE], vector[2 * _SIZE :]
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    orders = factorial(len(FILTERS))
    # of the filters that a document fails, each comes first in the same share of the orders
    shapley = {f: sum(n[m] * orders // m.bit_count() for m in range(_SIZE) if m & bit[f]) for f in FILTERS}
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            fails = [m for m in range(_SIZE) if m & bit[f]]
            here = [m for m in fails if not m & before]
            kept = sum(n[m] for m in range(_SIZE) if not m & (before | bit[f]))
            removed = sum(n[m] for m in here)
            yield (part, "".join(order), step, kept, removed, sum(n[m] for m in fails) - removed, n[bit[f]], sum(good[m] for m in here), sum(toxic[m] for m in here), shapley[f])
            before |= bit[f]


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", chain_bytes: int = CHAIN_BYTES) -> DataFrame:
    """What each filter removes at each step of every order, for each value of ``part_col``.

    Null and empty texts are copies of each other and fail A. A null part is the part of the empty string. Rows of one
    id and text are not copies of each other, rows of one id and other texts stand by themselves. A null id fails no E,
    makes none fail, and has no labels. Of several labels of an id any that says good, or toxic, counts; a null one says
    nothing. An empty table has no parts and gives no rows; other columns are ignored. A part is one vector of counts.
    """
    spark = docs.sparkSession
    rows = spark.createDataFrame(masks(docs, id_col, text_col, part_col, chain_bytes), "doc_id long, part string, mask int, n long", verifySchema=False)
    # an id that many rows have is a few counts before it meets its labels
    rows = rows.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).join(flagged(labels), "doc_id", "left")
    rows = rows.groupBy("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.sum("n").alias("n"))
    pairs = rows.select("part", "mask", "n", "good", "toxic").rdd.map(lambda r: (r[0], tuple(r[1:])))
    vectors = pairs.combineByKey(lambda row: _counted([0] * (3 * _SIZE), row), _counted, lambda a, b: [x + y for x, y in zip(a, b, strict=True)])
    return spark.createDataFrame(vectors.flatMap(lambda v: audit_part(*v)), AUDIT, verifySchema=False)
