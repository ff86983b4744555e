from __future__ import annotations

import numpy as np
from tempolith.llm.embeddings import MISSED, near_vectors, tables_and_bits

from .brute import components

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """Every pair, in double precision; ids are distinct."""
    good = [(i, v, x) for i, v, x in rows if i is not None and x is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    n = {i: 0 for i, _, _ in rows}
    links = []
    for k, (a, v, x) in enumerate(good):
        for b, w, y in good[k + 1 :]:
            if x == y and len(v) == len(w):
                p, q = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
                if p @ q >= 0.98 * (np.sqrt(p @ p) * np.sqrt(q @ q)):
                    links.append((a, b))
                    n[a] += 1
                    n[b] += 1
    root = components([i for i, _, _ in rows if i is not None], links)
    return sorted((i, n[i], root[i], i == root[i]) for i in n if i is not None)


def some_vectors():
    rng = np.random.default_rng(4)
    rows = []
    for k in range(40):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 12)):
            rows.append((len(rows), [float(np.float32(x)) for x in base + rng.normal(size=16) * rng.choice([0, 0.1, 0.2])], int(k % 3)))
    return rows


def test_links_equal_brute_force(spark):
    rows = some_vectors()
    assert sorted(map(tuple, near_vectors(spark.createDataFrame(rows, SCHEMA)).collect())) == plain(rows)


def test_cut_buckets_count_each_pair_once(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=8)
    rows = [(i, [float(np.float32(x)) for x in base + rng.normal(size=8) * 0.15], 1) for i in range(90)]
    rows += [(100 + i, rows[0][1], 1) for i in range(30)]
    assert sorted(map(tuple, near_vectors(spark.createDataFrame(rows, SCHEMA), part=16).collect())) == plain(rows)


def test_odd_vectors(spark):
    ones = [1.0, 1.0]
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (6, [], 1), (7, ones, None), (8, ones, 1), (9, [2.0, 2.0], 1), (10, [1.0, 1.0, 1.0], 1), (11, ones, 2), (12, [-0.0, 1.0], 2), (13, [0.0, 1.0], 2), (14, [1e-30, 1e-30], 1)]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA + ", n_links int, rep string")
    assert sorted(map(tuple, near_vectors(docs).collect())) == plain(rows)


def test_vectors_of_extreme_sizes(spark):
    rows = [(1, [1e-200, 0.0, 0.0]), (2, [0.0, 1e-200, 0.0]), (3, [0.0, 0.0, 1.0]), (4, [1e200, 0.0, 0.0]), (5, [0.0, 1e308, 1e300]), (6, [5e-324, 0.0, 0.0]), (7, [-1e-200, 0.0, 0.0])]
    found = near_vectors(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == [(1, 2, 1), (2, 1, 2), (3, 0, 3), (4, 2, 1), (5, 1, 2), (6, 2, 1), (7, 0, 7)]


def test_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (None, [1.0, 0.5], 1)]
    found = near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["kept"]) for r in found) == [("1", 1, True), ("1", 1, True), ("None", 0, True)]
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_different_vectors_of_one_id(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.02], 1), (4, [0.01, 1.0], 1)]
    found = sorted(map(tuple, near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert found == [(1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 1, False)]


def test_an_empty_part(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=8)
    rows = [(i, [float(np.float32(x)) for x in base + rng.normal(size=8) * 0.01], 1) for i in range(6)]
    for part in (1, 2, 3):
        assert sorted(map(tuple, near_vectors(spark.createDataFrame(rows, SCHEMA), part=part).collect())) == plain(rows)


def test_bits_and_tables_grow_with_the_vectors():
    seen = [tables_and_bits(n) for n in (1, 5000, 10**6, 10**9, 10**12)]
    assert seen == sorted(seen) and seen[-1][0] < 200
    for tables, bits in seen:
        assert (1 - (1 - np.arccos(0.98) / np.pi) ** bits) ** tables <= MISSED


def test_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    assert sorted(map(tuple, near_vectors(table).collect())) == plain(rows)
