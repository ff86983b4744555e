"""Ranked lexical search: matched (item, document, impact) arrays are sorted and summed, the best of each item kept in heaps."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappushpop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, settle, text_bytes

#: Documents returned for each item.
TOP = 20
#: Postings (distinct terms of an item) that are searched for in one pass over the documents; more take further passes.
BLOCK = 1 << 20
#: Matches that are accumulated at once.
MATCHES = 1 << 20

#: Separators become blanks and A-Z a-z, so that ``split`` finds the terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


@dataclass(frozen=True)
class Postings:
    """The items that ask for each term: those of term ``t`` are ``item[start[t] : start[t + 1]]``, each ``times`` times."""

    ids: list[int | None]
    vocabulary: dict[bytes, int]
    start: np.ndarray
    item: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int | None, str, int]]) -> Postings:
        """From (item, term, times), each (item, term) once."""
        ids = sorted({r[0] for r in rows}, key=lambda i: (i is not None, i))
        place = {i: at for at, i in enumerate(ids)}
        vocabulary = {t: at for at, t in enumerate(sorted({r[1].encode() for r in rows}))}
        term = np.array([vocabulary[r[1].encode()] for r in rows], np.int64)
        order = np.argsort(term, kind="stable")
        start = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))
        item = np.array([place[r[0]] for r in rows], np.int64)[order]
        return cls(ids, vocabulary, start, item, np.array([r[2] for r in rows], np.int64)[order])


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of unsigned keys, by stable counting sorts of 16 bits at a time from the lowest."""
    order = np.arange(len(keys))
    for shift in range(0, max(1, int(keys.max()).bit_length()) if len(keys) else 0, 16):
        digit = (keys[order] >> np.uint64(shift)).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]
    return order


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of each term."""
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


class Best:
    """The best documents of each item so far, in heaps whose least comes first."""

    def __init__(self, top: int) -> None:
        self.top = top
        self.heaps: dict[int, list[tuple[int, int]]] = {}

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        """Take in summed scores, sorted by item."""
        cuts = np.flatnonzero(np.diff(item)) + 1
        for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(item)], strict=True):
            heap = self.heaps.setdefault(int(item[at]), [])
            own, ids = score[at:end], doc[at:end]
            if len(heap) == self.top:  # what is below the least cannot enter
                some = own >= heap[0][0]
                own, ids = own[some], ids[some]
            if len(own) > self.top:
                some = own >= np.partition(own, len(own) - self.top)[len(own) - self.top]
                own, ids = own[some], ids[some]
            for entry in zip(own.tolist(), (-1 - ids).tolist(), strict=True):  # -1 - id keeps the order of all 64-bit ids
                if len(heap) < self.top:
                    heappush(heap, entry)
                else:
                    heappushpop(heap, entry)

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for item, heap in self.heaps.items():
            for score, doc in sorted(heap, reverse=True):
                yield item, -1 - doc, score


def accumulate(doc_at: np.ndarray, term: np.ndarray, impact: np.ndarray, postings: Postings, most: int = MATCHES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(item, document, score) of some documents' terms, sorted by item and document; documents are in order and never split.

    Matches of all documents and items are laid end to end, sorted by a key packed of item and document, and the impacts
    between equal keys are added up.
    """
    width = postings.start[term + 1] - postings.start[term]
    ends = np.flatnonzero(np.append(np.diff(doc_at) != 0, len(doc_at) > 0)) + 1
    upto = np.cumsum(width)[ends - 1] if len(ends) else ends
    at = done = 0
    while at < len(ends):
        more = max(at + 1, int(np.searchsorted(upto, done + most, side="right")))
        low, high = (ends[at - 1] if at else 0), ends[more - 1]
        w = width[low:high]
        n = int(w.sum())
        row = np.repeat(np.arange(low, high), w)
        place = np.repeat(postings.start[term[low:high]], w) + np.arange(n) - np.repeat(np.cumsum(w) - w, w)
        bits = max(1, int(doc_at[high - 1] + 1).bit_length())
        keys = postings.item[place].astype(np.uint64) << np.uint64(bits) | doc_at[row].astype(np.uint64)
        order = radix_order(keys)
        keys, each = keys[order], (impact[row] * postings.times[place])[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sums, keys = np.add.reduceat(each, starts), keys[starts]
        yield (keys >> np.uint64(bits)).astype(np.int64), (keys & np.uint64((1 << bits) - 1)).astype(np.int64), sums
        at, done = more, int(upto[more - 1])


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term, times) of all items; an item's rows count together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, t, n) for i, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True) for t, n in Counter(terms(text)).items()]
            ids, names, times = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([t.decode() for t in names], pa.string()), pa.array(times, pa.int64())], names=["item", "term", "times"])

    rows = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "item long, term string, times long").groupBy("item", "term").agg(F.sum("times").alias("times"))


def blocks(wanted: DataFrame, block: int) -> Iterator[Postings]:
    """The postings of ``wanted`` (item, term, times), whole items in blocks of about ``block`` postings."""
    n = wanted.count()
    if n <= block:
        found = [wanted] if n else []
    else:
        parts = -(-n // block)
        found = [wanted.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part) for part in range(parts)]
    for rows in found:
        table = rows.select("item", "term", "times").toArrow()
        if table.num_rows:
            yield Postings.of(list(zip(*(c.to_pylist() for c in table.columns), strict=True)))


def matched(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document: the number of its terms, and those in the vocabulary with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, names, counts, offsets = [], [], [], [0]
            for text in text_bytes(batch.column(1)):
                words = terms(text)
                own = Counter(t for t in map(vocabulary.get, words) if t is not None)
                n.append(len(words))
                names += own.keys()
                counts += own.values()
                offsets.append(len(names))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v, pa.int32())) for v in (names, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def _scored(postings: Postings, weight: np.ndarray, n_docs: int, n_terms: int, top: int, most: int):
    """(item, doc_id, score) of a task's best documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(top)
        for batch in batches:
            lists = batch.column(2)
            lengths = np.diff(lists.offsets.to_numpy())
            doc_at = np.repeat(np.arange(batch.num_rows), lengths)
            term = lists.flatten().to_numpy().astype(np.int64)
            tf = batch.column(3).flatten().to_numpy().astype(np.int64)
            m = 100 - 25 + (25 * batch.column(1).to_numpy() * n_docs) // n_terms
            impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc_at]))
            ids = batch.column(0).to_numpy()
            for item, doc, score in accumulate(doc_at, term, impact, postings, most):
                some = score > 0
                if some.any():
                    best.add(item[some], ids[doc[some]], score[some])
        yield _batch(best)

    return run


def _batch(best: Best) -> pa.RecordBatch:
    item, doc, score = zip(*best.rows(), strict=True) if best.heaps else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (item, doc, score)], names=["item", "doc_id", "score"])


def _chosen(top: int):
    """Of a partition's (item, doc_id, score) the best of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(top)
        for batch in batches:
            item, doc, score = (batch.column(c).to_numpy() for c in range(3))
            if len(item):
                order = np.argsort(item, kind="stable")
                best.add(item[order], doc[order], score[order])
        yield _batch(best)

    return run


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK, most: int = MATCHES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of the highest score above 0 for each item, ties by ascending id.

    Statistics cover all documents. A null text has no terms. Rows of one item id are one item, also those without an id;
    an item without terms, or none of whose terms scores, gives no rows. A document without an id counts in the
    statistics and is not returned; several rows of one id are documents of their own, which may all be returned. Empty
    tables give an empty one, other columns are ignored.

    The documents are read once for each block of items. A document's terms are looked up and summed where it is read;
    each task hands on its best documents of each item, which are sorted by range, chosen from, and chosen from again.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    wanted = settle(item_terms(items, item_col, item_text), "asked")
    found = None
    for postings in blocks(wanted, block):
        own = settle(matched(docs, postings.vocabulary, id_col, text_col), "matched")
        n_docs, n_terms = own.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        df = np.zeros(len(postings.vocabulary), np.int64)
        # one number for each term of the block
        held = own.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()
        df[held.column("t").to_numpy()] = held.column("df").to_numpy()
        rows = own.filter("doc_id is not null and size(terms) > 0")
        each = rows.mapInArrow(_scored(postings, weights(n_docs, df), n_docs, n_terms, top, most), "item long, doc_id long, score long")
        ids = spark.createDataFrame(list(enumerate(postings.ids)), "item long, item_id long")
        best = settle(each.repartitionByRange("item", "doc_id").mapInArrow(_chosen(top), "item long, doc_id long, score long"), "best")
        best = best.repartitionByRange("item").mapInArrow(_chosen(top), "item long, doc_id long, score long").join(F.broadcast(ids), "item")
        best = settle(best.select("item_id", "doc_id", "score"), "best")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    # an item has at most ``top`` rows by now
    entries = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "doc_id")))
    ranked = found.groupBy("item_id").agg(entries.alias("best")).select("item_id", F.posexplode("best").alias("at", "d"))
    return ranked.select("item_id", (F.col("at") + 1).cast("int").alias("rank"), "d.doc_id", (-F.col("d.less")).alias("score"))
