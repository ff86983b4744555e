from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tempolith.llm.search import Best, radix_order, search, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item_id long, score string"
ITEMS = "item_id long, text string, doc_id string"


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, top=20):
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(plain_terms(t))
    out = []
    for item, wanted in asked.items():
        found = []
        for (doc_id, bag), size in zip(bags, sizes, strict=True):
            score = 0
            for t, times in wanted.items():
                if bag[t]:
                    m = 75 + 25 * size * n // total
                    score += times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
            if score > 0 and doc_id is not None:
                found.append((-score, doc_id))
        out += [(item, rank, doc_id, -score) for rank, (score, doc_id) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def found(frame):
    return sorted(map(tuple, frame.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_search_of_documents_equals_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text")
    expected = plain_search([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert found(search(docs, items)) == expected and len(expected) > 100
    # the same in several blocks of items and small pieces of matches
    assert found(search(docs.repartition(5), items, block=500, most=50)) == expected


def test_odd_rows(spark):
    docs = [(None, "alpha beta"), (1, None), (2, ""), (3, "Alpha, ALPHA alpha"), (4, "alpha"), (4, "alpha"), (4, "beta gamma"), (-5, "alpha"), (6, "ÀÉ àé x1_y2"), (7, "é" * 90_000), (8, "gamma " * 70_000), (9, "... !?"), (2**63 - 1, "alpha"), (-(2**63), "alpha")] + [(100 + i, "delta alpha") for i in range(60)]
    items = [(1, "alpha ALPHA beta"), (2, None), (3, "..."), (4, "unseen"), (5, "gamma"), (5, "gamma beta"), (None, "x1 é beta"), (7, "àé ÀÉ y2"), (8, "delta"), (8, "delta")]
    frame = spark.createDataFrame([(*d, 9, "z") for d in docs], DOCS).repartition(6)
    asked = spark.createDataFrame([(*i, "w") for i in items], ITEMS)
    assert found(search(frame, asked)) == plain_search(docs, items)
    assert found(search(frame, asked, block=2, most=1)) == plain_search(docs, items)
    assert found(search(frame, asked, top=3)) == plain_search(docs, items, 3)
    assert found(search(frame.limit(0), asked)) == [] == found(search(frame, asked.limit(0))) == found(search(frame.filter("doc_id = 1"), asked))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 40), max_size=60))
def test_radix_order(keys):
    array = np.array(keys, np.uint64)
    assert radix_order(array).tolist() == np.argsort(array, kind="stable").tolist()


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aZé_0 9{/@`\n\x7f\x80", max_size=60))
def test_terms(text):
    assert [t.decode() for t in terms(text.encode())] == plain_terms(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-5, 5), st.integers(1, 4)), max_size=80), st.integers(1, 5), st.integers(1, 9))
def test_heaps_keep_the_best(rows, top, size):
    best = Best(top)
    for at in range(0, len(rows), size):
        part = np.array(sorted(rows[at : at + size]), np.int64).reshape(-1, 3).T
        best.add(*part)
    expected = [r for i in range(4) for r in sorted((r for r in rows if r[0] == i), key=lambda r: (-r[2], r[1]))[:top]]
    assert sorted(best.rows()) == sorted(expected)
