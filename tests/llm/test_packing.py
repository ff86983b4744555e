from __future__ import annotations

import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from tempolith.llm.packing import OVERHEAD, pack, pack_documents


def plain(lengths, capacities, overhead):
    """The same rules, by looking at every bin and every later piece."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    bins = []
    for k, i in enumerate(order):
        fitting = [b for b in bins if b["room"] >= lengths[i]]
        if fitting:
            b = min(fitting, key=lambda b: (b["room"], b["no"]))
        else:

            def cost(size, k=k, i=i):
                beside = sum(lengths[j] for j in order[k + 1 :] if lengths[j] <= size - lengths[i])
                return (size + overhead) / max(1, min(size, lengths[i] + beside)), size

            size = min((c for c in capacities if c >= lengths[i]), key=cost)
            b = {"room": size, "no": len(bins), "content": []}
            bins.append(b)
        b["room"] -= lengths[i]
        b["content"].append(i)
    return [(min(c for c in capacities if c >= sum(lengths[i] for i in b["content"])), b["content"]) for b in bins]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=40))
def test_pack_equals_the_rules(lengths):
    found = pack(lengths, (10, 20, 40), 2)
    assert [(size, [i for i, _ in content]) for size, content in found] == plain(lengths, (10, 20, 40), 2)
    for _, content in found:
        at = 0
        for i, offset in content:
            assert offset == at
            at += lengths[i]


def verify(rows, expected, capacities):
    parts, bins = defaultdict(int), defaultdict(list)
    for r in rows:
        parts[r["doc_id"]] += r["length"]
        bins[r["bin_id"]].append(r)
    assert dict(parts) == expected
    for content in bins.values():
        size = {r["capacity"] for r in content}
        filled = sum(r["length"] for r in content)
        assert len(size) == 1 and size == {min(c for c in capacities if c >= filled)}
        spans = sorted((r["bin_offset"], r["bin_offset"] + r["length"]) for r in content)
        assert all(a[1] <= b[0] or a[0] == a[1] for a, b in zip(spans, spans[1:], strict=False))


def test_whole_documents_are_packed(spark):
    rng = random.Random(1)
    lengths = {i: rng.choice([0, 1, 30, 700, 5000, 8192, 20_000]) for i in range(500)}
    frame = spark.createDataFrame([(i, n, 0, "x") for i, n in lengths.items()], "doc_id long, n_tokens long, part int, bin_id string")
    for chunk in (7, 20_000):
        verify(pack_documents(frame, chunk=chunk).collect(), lengths, (512, 1024, 2048, 4096, 8192))


def test_bins_do_not_depend_on_the_split(spark):
    rng = random.Random(3)
    rows = [(i % 900, min(30_000, int(rng.lognormvariate(6, 1.2)))) for i in range(1000)] + [(7, 100)] * 300
    frame = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    found = [sorted(map(tuple, pack_documents(frame.repartition(n), chunk=400).collect())) for n in (1, 13)]
    assert found[0] == found[1] and len(found[0]) > len(rows)
    bins = {r[4]: r[5] for r in found[0]}
    assert sum(bins.values()) < 1.03 * sum(n for _, n in rows)


def test_one_group_equals_the_rules(spark):
    """All of a table that fits one group, against the plain packing of its pieces."""
    rng = random.Random(5)
    lengths = {i: rng.choice([0, 1, 30, 700, 5000, 8192, 20_000, rng.randrange(3000)]) for i in range(120)}
    found = pack_documents(spark.createDataFrame(list(lengths.items()), "doc_id long, n_tokens long")).collect()
    pieces = [(min(8192, n - part * 8192), doc, part) for doc, n in lengths.items() for part in range(max(1, -(-n // 8192)))]
    rest = sorted((p for p in pieces if p[0] < 8192), key=lambda p: (-p[0], p[1], p[2]))
    expected = [(size, sorted((rest[i][1], rest[i][2]) for i in content)) for size, content in plain([p[0] for p in rest], (512, 1024, 2048, 4096, 8192), OVERHEAD)]
    expected += [(8192, [p[1:]]) for p in pieces if p[0] == 8192]
    bins = defaultdict(list)
    for r in found:
        bins[r["bin_id"], r["capacity"]].append((r["doc_id"], r["part"]))
    assert sorted((size, sorted(content)) for (_, size), content in bins.items()) == sorted(expected)


def test_odd_rows(spark):
    frame = spark.createDataFrame([(1, None), (None, 5), (2, -3), (3, 9), (3, 9)], "doc_id long, n_tokens long")
    verify(pack_documents(frame).collect(), {1: 0, None: 5, 2: 0, 3: 18}, (512, 1024, 2048, 4096, 8192))
    assert pack_documents(frame.limit(0)).collect() == []


def test_little_is_wasted():
    rng = random.Random(2)
    lengths = [min(8192, int(rng.lognormvariate(6, 1.2))) for _ in range(5000)]
    assert sum(size for size, _ in pack(lengths)) < 1.01 * sum(lengths)
