from __future__ import annotations

import math
import os
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
from tempolith.llm.sharding import hilbert_index, shard_documents, write_shards

DOCS = "doc_id long, text string, lang string, source string, shard int, size string"


def test_curve_visits_every_cell_by_single_steps():
    for dims, bits in ((2, 3), (3, 2), (3, 3), (4, 2)):
        points = np.array(list(product(range(1 << bits), repeat=dims))).T
        index = hilbert_index(points, bits)
        assert sorted(index) == list(range(len(index)))
        path = points[:, np.argsort(index)]
        assert (np.abs(np.diff(path, axis=1)).sum(axis=0) == 1).all()


def check(rows, expected):
    assert len(rows) == len(expected)
    texts = defaultdict(list)
    for i, t in expected:
        texts[i].append((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())))
    by_shard = defaultdict(list)
    for r in rows:
        assert (r["size"], r["text_crc32"]) in texts[r["doc_id"]] and r["law"] == "rows" and r["grown_shard"] is None
        by_shard[r["shard"]].append(r["slot"])
    counts = [len(by_shard[s]) for s in range(24)]
    assert max(counts) - min(counts) <= 1 and set(by_shard) <= set(range(24))
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())


def test_law_holds_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = shard_documents(docs).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    # pruning: a shard covers few of the sources or languages
    where = {r["doc_id"]: (r["lang"], r["source"]) for r in docs.collect()}
    pairs = defaultdict(set)
    for r in rows:
        pairs[r["shard"]].add(where[r["doc_id"]])
    assert np.mean([len(v) for v in pairs.values()]) < 0.4 * len(set(where.values()))
    assert np.mean([len({lang for lang, _ in v}) for v in pairs.values()]) <= 2
    assert np.mean([len({source for _, source in v}) for v in pairs.values()]) <= 8


def plain_shards(rows, shards=24):
    """The whole query over lists: quantile cells, places on the curve, one sort, one cut."""

    def numbers(values):
        known = sorted(v for v in values if v is not None)
        if not known:
            return [None] * len(values)
        if isinstance(known[0], str):
            raw = sorted(v.encode() for v in known)
            shared = len(os.path.commonprefix([raw[0], raw[-1]]))
            return [None if v is None else int.from_bytes((v.encode() + bytes(6) + bytes(shared))[shared : shared + 6]) for v in values]
        return values

    def cells(values):
        known = sorted(v for v in values if v is not None)
        edges = sorted({known[max(0, math.ceil(k / 64 * len(known)) - 1)] for k in range(1, 64)} - {known[-1]}) if known else []
        return [0 if v is None else sum(v > e for e in edges) * 64 // (len(edges) + 1) for v in values]

    sizes = [len((t or "").encode()) + 8 for _, t, _, _ in rows]
    points = np.array([cells(numbers(x)) for x in ([r[2] for r in rows], [r[3] for r in rows], sizes)])
    index = hilbert_index(points)
    order = sorted(range(len(rows)), key=lambda i: (index[i], zlib.crc32((rows[i][1] or "").encode()), rows[i][0]))
    starts = [-(-shard * len(rows) // shards) for shard in range(shards)]
    return sorted((rows[i][0], place * shards // len(rows), place - starts[place * shards // len(rows)]) for place, i in enumerate(order))


def test_query_equals_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(5000, None, None, "src1"), (5001, "", "en", None), (5002, "é" * 40, "zz", "other")], docs.schema)
    docs = docs.union(odd)
    found = sorted((r["doc_id"], r["shard"], r["slot"]) for r in shard_documents(docs).collect())
    assert found == plain_shards([tuple(r) for r in docs.collect()])


def test_odd_tables(spark):
    rows = [(None, None, None, None), (1, "", "en", "s"), (1, "", "en", "s"), (2, "é" * 9, None, "s"), (3, "x" * 90_000, "en", None)] + [(5, "copy", "en", "s")] * 60
    frame = spark.createDataFrame([(*r, 0, "z") for r in rows], DOCS)
    check(shard_documents(frame).collect(), [(r[0], r[1]) for r in rows])
    assert shard_documents(frame.limit(0)).collect() == []


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    write_shards(docs, shard_documents(docs, 4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and sorted(r["shard"] for r in back.select("shard").distinct().collect()) == [0, 1, 2, 3]
