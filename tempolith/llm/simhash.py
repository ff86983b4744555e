"""SimHash near-duplicates: fingerprints of word shingles, compared as vertical bit planes with carry-save counters."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, local_components
from .store import bounded_batches, join_counted, settle, text_bytes

#: Fingerprints of one key that a task compares at once; a key with more is cut into such parts, compared two by two.
PART = 16_384
#: Fingerprints whose comparisons run together.
WAVE = 64
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


#: Bytes of a text whose words are held at once.
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def shingles(text: bytes | None, size: int, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The runs of ``size`` words of a whole text, A-Z lower-cased and space-joined, some at a time.

    A text of fewer words gives all of them as one run; a text that is null or has no word gives nothing.
    """
    text, at, kept, any_run = text or b"", 0, [], False
    while at < len(text):
        gap = _SPACE.search(text, at + piece) if at + piece < len(text) else None
        end = gap.start() if gap else len(text)
        words = kept + text[at:end].lower().split()
        at = end
        if len(words) >= size:
            any_run = True
            yield list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))
            kept = words[len(words) - size + 1 :]
        else:
            kept = words
    if kept and not any_run:
        yield [b" ".join(kept)]


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """64 bits, each set where over half the shingles' XXH64 set it; 0 for a text that is null or has no word."""
    hashed = xxhash.xxh64_intdigest
    votes, n = np.zeros(64, np.int64), 0
    for runs in shingles(text, shingle):
        for at in range(0, len(runs), 1 << 16):
            some = np.array([hashed(run, seed) for run in runs[at : at + (1 << 16)]], "<u8").view(np.uint8).reshape(-1, 8)
            votes += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(runs)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long) of every whole text: words are runs of non-space characters, A-Z lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t, shingle) for t in text_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(values.view(np.int64))], names=["id", "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def blocks_for(n: int, radius: int = 3) -> int:
    """Into how many blocks ``n`` fingerprints are cut: so many that those of a key are few, unless they are near each other.

    More blocks mean more and longer keys; the links found are the same.
    """
    return next(b for b in range(radius + 2, 17) if b == 16 or n >> 4 < 1 << (64 * (b - radius) // b))


def block_keys(fp: F.Column, radius: int = 3, blocks: int = 5) -> F.Column:
    """The keys of a fingerprint: for each choice of blocks - radius blocks, their bits and the choice's number.

    Two fingerprints within ``radius`` bits differ in at most ``radius`` blocks, so they share a key.
    """
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum((1 << edges[b + 1]) - (1 << edges[b]) for b in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(number).alias("choice"), fp.bitwiseAND(F.lit(mask)).alias("bits")))
    return F.explode(F.array(*keys))


def within_radius(planes: np.ndarray, query: np.ndarray, word: np.ndarray, lanes: np.ndarray, radius: int = 3) -> np.ndarray:
    """For comparison i, the lanes of ``planes[:, word[i]]`` among ``lanes[i]`` that differ from ``query[i]`` in at most ``radius`` bits.

    ``planes[b, w]`` holds bit b of 64 fingerprints, ``query[i]`` one fingerprint as 64-bit words. The differing bits of
    all lanes are added plane by plane into carry-save counters, one word per counter bit, which begin so that the
    carry out of the last says that the radius is exceeded, for good. Words whose lanes are all too far are abandoned
    after every eighth plane.
    """
    if query.ndim == 1:
        query = query[:, None]
    near = np.zeros(len(query), np.uint64)
    at = np.arange(len(query))
    far = ~lanes
    bits = radius.bit_length()
    begin = (1 << bits) - 1 - radius
    count = [np.full(len(query), ONES if begin >> c & 1 else 0, np.uint64) for c in range(bits)]
    for b in range(len(planes)):
        carry = planes[b, word] ^ (np.uint64(0) - ((query[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)))
        for c in count:
            c ^= carry
            carry &= ~c
        far |= carry
        if b % 8 == 7:
            live = np.flatnonzero(far != ONES)
            if len(live) < len(at):
                at, query, word, far, count = at[live], query[live], word[live], far[live], [c[live] for c in count]
            if not len(at):
                break
    near[at] = ~far
    return near


def _lanes(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(comparison, lane) of every bit set."""
    some = np.flatnonzero(near)
    at, lane = np.nonzero(np.unpackbits(near[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return some[at], lane


def _small_runs(fp: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of 2 to 64 fingerprints, each run one word of lanes."""
    run = np.repeat(np.arange(len(start)), size)
    row = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    lane = (row - start[run]).astype(np.uint64)
    bits, first = fp[row], np.concatenate([[0], np.cumsum(size)[:-1]])
    planes = np.stack([np.bitwise_or.reduceat(((bits >> np.uint64(b)) & np.uint64(1)) << lane, first) for b in range(64)])
    full = ONES >> (np.uint64(64) - size.astype(np.uint64))
    later = full[run] & ~(((np.uint64(1) << lane) << np.uint64(1)) - np.uint64(1))
    asks = np.flatnonzero(later)
    at, hit = _lanes(within_radius(planes, bits[asks], run[asks], later[asks]))
    return bits[asks][at], fp[start[run[asks][at]] + hit]


def _large_run(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected in one run. A lane that was reached is no longer compared with, so dense runs cost little."""
    size = len(fp)
    words = -(-size // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[:size] = fp
    lane = np.tile(np.arange(64, dtype=np.uint64), words)
    planes = np.stack([np.bitwise_or.reduce((((padded >> np.uint64(b)) & np.uint64(1)) << lane).reshape(words, 64), axis=1) for b in range(64)])
    open_lanes = np.full(words, ONES)
    if size % 64:
        open_lanes[-1] = ONES >> np.uint64(64 - size % 64)
    waiting: list[int] = []
    found_u, found_v = [], []
    while True:
        fresh = len(waiting) < WAVE
        if fresh:
            at, lane_ = _lanes(open_lanes)
            waiting = waiting + (at * 64 + lane_)[: WAVE - len(waiting)].tolist()
        if not waiting:
            break
        asks, waiting = np.array(waiting[:WAVE]), waiting[WAVE:]
        some = np.flatnonzero(open_lanes)
        word = np.tile(some, len(asks))
        query = np.repeat(asks, len(some))
        lanes = open_lanes[word]
        lanes[word == query // 64] &= ~(np.uint64(1) << (query[word == query // 64] % 64).astype(np.uint64))
        at, hit = _lanes(within_radius(planes, fp[query], word, lanes))
        target = word[at] * 64 + hit
        found_u.append(fp[query[at]])
        found_v.append(fp[target])
        np.bitwise_and.at(open_lanes, asks // 64, ~(np.uint64(1) << (asks % 64).astype(np.uint64)))
        reached = np.unique(target)
        reached = reached[(open_lanes[reached // 64] >> (reached % 64).astype(np.uint64)) & np.uint64(1) == 1]
        np.bitwise_and.at(open_lanes, reached // 64, ~(np.uint64(1) << (reached % 64).astype(np.uint64)))
        waiting += reached.tolist()
    return np.concatenate(found_u), np.concatenate(found_v)


def _link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition sorted by key, as stars; a key's rows follow each other."""

    def linked(run: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.empty(0, int)
        size = np.diff(np.concatenate([start, [len(run)]]))
        parts = []
        few = (size > 1) & (size <= 64)
        if few.any():
            parts.append(_small_runs(fp, start[few], size[few]))
        parts += [_large_run(fp[s : s + n]) for s, n in zip(start[size > 64], size[size > 64], strict=True)]
        u, v = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (fp[:0], fp[:0])
        u, v = local_components(u, v)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows, last, number = 0, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(4)])
        new = np.concatenate([[last is None or (keys[:, 0] != last).any()], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
        run, fp = number + np.cumsum(new), batch.column(4).to_numpy().view(np.uint64)
        number, last = int(run[-1]), keys[:, -1]
        held.append((run, fp))
        rows += batch.num_rows
        if rows >= 500_000 and run[0] != run[-1]:
            run, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(run, run[-1]))
            yield linked(run[:cut], fp[:cut])
            held, rows = [(run[cut:], fp[cut:])], len(run) - cut
    if held:
        run, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        yield linked(run, fp)


def near_links(prints: DataFrame, part: int = PART, blocks: int = 5) -> DataFrame:
    """Links (u, v) that connect the distinct fingerprints ``fp`` of ``prints`` within 3 bits of each other, met by keys of ``blocks``.

    A key held by more than ``part`` fingerprints is cut into parts by hash, and each two parts meet in a task of their
    own, so no task sees more than about 2 * ``part`` of them. All links are found; each task returns stars only.
    """
    keyed = prints.select("fp", block_keys(F.col("fp"), blocks=blocks).alias("key")).select("key.choice", "key.bits", "fp")
    hot = settle(keyed.groupBy("choice", "bits").count().filter(F.col("count") > part).select("choice", "bits", F.ceil(F.col("count") / part).cast("int").alias("parts")), "hot")
    n_hot = hot.count()
    if n_hot:
        # one row takes some 24 bytes, and a broadcast holds at most 100,000 of them
        keyed = keyed.join(F.broadcast(hot) if n_hot <= 100_000 else hot, ["choice", "bits"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        keyed = keyed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        keyed = keyed.select("choice", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    else:
        keyed = keyed.select("choice", "bits", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    runs = keyed.repartition("choice", "bits", "i", "j").sortWithinPartitions("choice", "bits", "i", "j")
    return runs.mapInArrow(_link_runs, "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document, by fingerprints within 3 bits of each other.

    Equal fingerprints become one node before any comparison, so groups of copies, however large, cost one row each.
    Texts that are null, empty or without a word have fingerprint zero, which links like any other. A null id takes part
    but names no component (null, if no document of it has an id). Repeated ids keep their rows; an empty table gives an
    empty one; other columns are ignored.
    """
    prints = settle(fingerprints(docs, id_col, text_col, shingle), "prints")
    nodes = settle(prints.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("rows")), "nodes")
    # components of fingerprints, then the smallest document of each
    roots = connected_components(near_links(nodes.select("fp"), blocks=blocks_for(nodes.count())))
    nodes = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "rep", "rows", F.coalesce("component", "fp").alias("root"))
    nodes = settle(nodes, "roots")
    least = nodes.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("prints"))
    nodes = join_counted(nodes, least, ["root"], "prints").select("fp", "rows", "component_id")
    return join_counted(prints, nodes, ["fp"], "rows").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
