"""Best-fit packing into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, settle

#: Permitted sequence lengths, in tokens.
CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: What a sequence costs besides its length.
OVERHEAD = 32
#: Pieces that are packed together, about.
CHUNK = 20_000

Bin = tuple[int, list[tuple[int, int]]]


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> list[Bin]:
    """Bins as (capacity, [(piece, offset)]) for pieces no longer than the largest capacity.

    Pieces are taken from long to short, equal ones in their order. A piece goes into the open bin that it leaves the
    least room in, the oldest of equal ones. If none has room, a bin is opened in the size that costs least for each
    token it can come to hold: the piece and, up to the size, the later pieces that fit beside it; the smaller of equal
    ones. In the end each bin shrinks to the smallest capacity that holds its contents.
    """
    sizes = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    sorted_down = [lengths[i] for i in order]
    rising = [-x for x in sorted_down]
    after = [0] * (len(order) + 1)  # tokens from a place to the end
    for k in range(len(order) - 1, -1, -1):
        after[k] = after[k + 1] + sorted_down[k]
    rooms: list[tuple[int, int]] = []
    bins: list[list[tuple[int, int]]] = []
    for k, i in enumerate(order):
        length = lengths[i]
        at = bisect_left(rooms, (length, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            best = None
            for size in sizes:
                if size >= length:
                    beside = after[max(k + 1, bisect_left(rising, length - size))]
                    cost = (size + overhead) / max(1, min(size, length + beside))
                    if best is None or cost < best[0]:
                        best = (cost, size)
            room, b = best[1], len(bins)
            bins.append([])
        bins[b].append((i, room))
        insort(rooms, (room - length, b))
    out: list[Bin] = []
    for content in bins:
        offset, placed = 0, []
        for i, _ in content:
            placed.append((i, offset))
            offset += lengths[i]
        out.append((sizes[bisect_left(sizes, offset)], placed))
    return out


SCHEMA = "doc_id long, part int, start long, length long, bin_id long, capacity int, bin_offset long"


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    """64 well-mixed bits of some numbers."""
    h = np.uint64(0x9E3779B97F4A7C15)
    for part in parts:
        h = (h ^ np.asarray(part).astype(np.int64).view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def _pieces(most: int, groups: int):
    """The pieces of each (doc_id, n, copies) with their group, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def emit() -> pa.RecordBatch:
            doc, known, n, copy, part = (np.concatenate(x) for x in zip(*held, strict=True))
            start = part * most
            group = _mixed(doc, known, n, copy, part) % np.uint64(groups)
            columns = [pa.array(doc, pa.int64(), mask=known == 0), pa.array(part.astype(np.int32)), pa.array(start), pa.array(np.minimum(most, n - start)), pa.array(copy), pa.array(group.astype(np.int64))]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "start", "length", "copy", "grp"])

        for batch in batches:
            for doc, n, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = max(1, -(-n // most))
                for at in range(0, copies * parts, 100_000):
                    number = np.arange(at, min(copies * parts, at + 100_000))
                    held.append((np.full(len(number), doc or 0), np.full(len(number), int(doc is not None)), np.full(len(number), n), number // parts, number % parts))
                    rows += len(number)
                    if rows >= 100_000:
                        yield emit()
                        held, rows = [], 0
        if held:
            yield emit()

    return run


def _packed(sizes: tuple[int, ...]):
    """Packs the groups of a partition sorted by group, one after the other."""

    def packed(group: int, rows: list[tuple]) -> pa.RecordBatch:
        most = sizes[-1]
        rest = [r for r in rows if r[3] < most]
        bins = [(most, [(r, 0)]) for r in rows if r[3] == most]
        bins += [(size, [(rest[i], offset) for i, offset in content]) for size, content in pack([r[3] for r in rest], sizes)]
        out = [(*r, (group << 32) + number, size, offset) for number, (size, content) in enumerate(bins) for r, offset in content]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        names = ["doc_id", "part", "start", "length", "bin_id", "capacity", "bin_offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = -1, []
        for batch in batches:
            for *row, grp in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "start", "length", "grp")), strict=True):
                if grp != group and rows:
                    yield packed(group, rows)
                    rows = []
                group = grp
                rows.append(tuple(row))
        if rows:
            yield packed(group, rows)

    return run


def pack_documents(lengths: DataFrame, capacities: tuple[int, ...] = CAPACITIES, chunk: int = CHUNK, id_col: str = "doc_id", length_col: str = "n_tokens") -> DataFrame:
    """(doc_id, part, start, length, bin_id, capacity, bin_offset): where the tokens of every row go.

    A document longer than the largest capacity is cut: full parts fill bins of their own, the rest is packed. A hash of
    id, length and part deals the pieces into groups of about ``chunk``, as many as the table needs; a group is packed as
    a whole, so bins do not depend on how the input is split, and a task holds a bounded number of lengths. Only
    lengths are shuffled. Null and negative lengths count as 0; an empty document still has its row. Repeated rows are
    packed each, an empty table gives an empty one, other columns are ignored.
    """
    sizes = tuple(sorted(capacities))
    bounded_batches(lengths.sparkSession)
    rows = lengths.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    rows = settle(rows.groupBy("doc_id", "n").agg(F.count("*").alias("copies")), "lengths")
    pieces = rows.agg(F.sum(F.col("copies") * F.greatest(F.ceil(F.col("n") / sizes[-1]), F.lit(1)))).first()[0] or 0
    dealt = rows.mapInArrow(_pieces(sizes[-1], max(1, -(-int(pieces) // chunk))), "doc_id long, part int, start long, length long, copy long, grp long")
    dealt = dealt.repartition("grp").sortWithinPartitions("grp", F.desc("length"), "doc_id", "part", "copy")
    return dealt.mapInArrow(_packed(sizes), SCHEMA)
