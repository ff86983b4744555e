"""Document fingerprints: hashed byte triplets are counted in buckets, a digest has each bucket's quartile and the length."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, settle, text_bytes

#: Buckets of a digest, two bits each.
BUCKETS = 256
#: Where the second and third byte of a triplet lie after its first. Neighbouring bytes tell the language; these, a word
#: apart, tell the text: on the sample documents they part edited texts from unrelated ones best.
SECOND, THIRD = 3, 7
#: Steps of the length code for each doubling, and what a step beyond the first, and all of them together, add to a difference.
LENGTH_STEPS, STEP_COST, LENGTH_COST = 8, 2, 64
#: What three quartiles apart count; and the difference that two unrelated digests have on average, from which on they are not alike at all.
FAR = 6
UNRELATED = BUCKETS * (6 * 1 + 4 * 2 + 2 * FAR) / 16

_MIX = np.uint32(0x9E3779B1)


def digest(text: bytes) -> bytes:
    """65 bytes: the length code, then the quartile of each bucket's count, four buckets a byte.

    Triplets go round the end, so a text has as many as bytes. Counts up to the first quartile's are 0, above the third's
    3. An empty text has length 0 and no counts.
    """
    n = len(text)
    ring = np.resize(np.frombuffer(text, np.uint8), n + THIRD).astype(np.uint32) if n else np.zeros(THIRD, np.uint32)
    triplets = ring[:n] << np.uint32(16) | ring[SECOND : n + SECOND] << np.uint32(8) | ring[THIRD:]
    mixed = (triplets ^ (triplets >> np.uint32(15))) * _MIX
    counts = np.bincount(mixed >> np.uint32(24), minlength=BUCKETS)
    edges = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = np.searchsorted(edges, counts, side="left").astype(np.uint8).reshape(-1, 4)
    packed = codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]
    return bytes([min(255, round(LENGTH_STEPS * np.log2(1 + n)))]) + packed.tobytes()


def _codes(prints: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), 1 + BUCKETS // 4)
    packed = raw[:, 1:, None] >> np.array([6, 4, 2, 0], np.uint8) & np.uint8(3)
    return raw[:, 0].astype(np.int64), packed.reshape(len(prints), BUCKETS).astype(np.int8)


def likeness(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """From 0 (as different as unrelated digests are, or more) to 1 (equal) of each pair of digests."""
    (la, qa), (lb, qb) = _codes(a), _codes(b)
    apart = np.abs(qa - qb)
    score = (apart + (apart == 3) * np.int8(FAR - 3)).sum(axis=1, dtype=np.int64)
    score += np.minimum(LENGTH_COST, STEP_COST * np.maximum(0, np.abs(la - lb) - 1))
    return np.maximum(0.0, 1.0 - score / UNRELATED)


def edited(text: str, following: str) -> str:
    """The text, its last half of code points replaced by as many first ones of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint): the digest of every text, as hexadecimal digits; a null text is an empty one. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [digest(text or b"").hex() for text in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


_FOUND = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compared(rows: list[tuple[int | None, str, bytes]], following: list[tuple[str, bytes]]) -> list[pa.Array]:
    """The columns of _FOUND of rows (id, text, digest), each beside the text and the digest that follow."""
    changed = [edited(text, after).encode() for (_, text, _), (after, _) in zip(rows, following, strict=True)]
    own, others = [p for *_, p in rows], [digest(c) for c in changed]
    values = [r[0] for r in rows], [len(r[1]) for r in rows], [hashlib.sha256(c).digest() for c in changed], own, others, likeness(own, others), likeness(own, [p for _, p in following])
    kinds = pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()
    return [pa.array(v, k) for v, k in zip(values, kinds, strict=True)]


_ENDS = "place int, first string, last string"
_NAMES = [c.split()[0] for c in f"{_FOUND}, {_ENDS}".split(", ")]


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row of a sorted partition beside the next one; its last row, whose next is elsewhere, with the texts of both ends."""
    place, first, held = TaskContext.get().partitionId(), None, []
    for batch in batches:
        for doc_id, raw in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
            held.append((doc_id, (raw or b"").decode(), digest(raw or b"")))
        first = held[0][1] if first is None and held else first
        pairs = list(pairwise(held))
        if pairs:
            empty = [pa.nulls(len(pairs), k) for k in (pa.int32(), pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([*_compared([a for a, _ in pairs], [b[1:] for _, b in pairs]), *empty], names=_NAMES)
        held = held[-1:]
    if held:
        blanks = [pa.nulls(1, k) for k in (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.int64()), *blanks, pa.array([place], pa.int32()), pa.array([first]), pa.array([held[0][1]])], names=_NAMES)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last rows of partitions (id, text, following text)."""
    for batch in batches:
        ids, texts, after = (batch.column(c).to_pylist() for c in range(3))
        columns = _compared([(i, t, digest(t.encode())) for i, t in zip(ids, texts, strict=True)], [(t, digest(t.encode())) for t in after])
        yield pa.RecordBatch.from_arrays(columns, names=_NAMES[: len(columns)])


def edit_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The edited text takes its second half from the next document, by ascending id, the last one's from the first; see
    ``edited`` and ``likeness``. A null text is an empty one. Null ids come first; rows of one id lie in an order that
    depends on their texts, equal rows beside each other. A single document follows itself, an empty table gives an
    empty one, other columns are ignored. Texts are sorted by range, so rows of one id may lie in several tasks; what a
    task lacks is the first text of the next one, and of these there is one for each task.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumns({"h": F.xxhash64("text"), "m": F.monotonically_increasing_id()})
    order = ["doc_id", "h", "m"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    found = settle(ranged.mapInArrow(_along, f"{_FOUND}, {_ENDS}"), "digests")
    inner, ends = found.filter("place is null"), found.filter("place is not null")
    # one number for each task
    places = sorted(r[0] for r in ends.select("place").collect())
    following = spark.createDataFrame(list(zip(places, places[1:] + places[:1], strict=True)), "place int, following int")
    firsts = ends.select(F.col("place").alias("following"), F.col("first").alias("after"))
    pairs = ends.join(following, "place").join(firsts, "following").select("doc_id", "last", "after")
    outer = pairs.mapInArrow(_across, _FOUND)
    hexed = {c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    return inner.select(outer.columns).unionByName(outer).withColumns(hexed)
