from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from tempolith.llm import simhash
from tempolith.llm.components import connected_components
from tempolith.llm.simhash import near_links, simhash_components, within_radius

from .brute import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain(rows):
    prints = {i: plain_fingerprint(t) for i, t in rows}
    ids = sorted(prints)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3]
    root = components(ids, links)
    return sorted((i, f"{prints[i]:016x}", root[i]) for i in ids)


def some_texts(n=120):
    rng = random.Random(3)
    words = ["Alpha", "beta", "É", "d x", "straße", "x", "longerword", "Z9"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 5, 40])))
        rows.append((i, text))
    base = " ".join(rng.choice(words) for _ in range(400)).split()
    for i in range(n, n + 40):
        near = list(base)
        near[rng.randrange(400)] = "changed"
        rows.append((i, "\t\n ".join(near)))
    return rows + [(n + 40, None), (n + 41, ""), (n + 42, " \x0b\n"), (n + 43, "word " * 30_000)]


def test_components_equal_brute_force(spark):
    rows = some_texts()
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, component_id int, fp int")
    assert sorted(map(tuple, simhash_components(docs).collect())) == plain(rows)


def test_empty_table(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_hot_keys_are_cut_without_losing_links(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    prints = {0, 2**64 - 1}
    for b in base:
        for _ in range(150):
            x = int(b)
            for bit in rng.choice(64, rng.integers(0, 7), replace=False):
                x ^= 1 << int(bit)
            prints.add(x)
    signed = [p - (p >> 63 << 64) for p in prints]
    expected = components(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3])
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    for part in (20, 70, 10_000):
        found = dict(map(tuple, connected_components(near_links(frame, part)).collect()))
        assert {n: found.get(n, n) for n in signed} == expected


def test_large_and_small_runs_agree():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 1, dtype=np.uint64)[0]
    fp = np.array([int(base) ^ sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in range(400)], np.uint64)
    fp = np.unique(fp)
    u, v = simhash._large_run(fp)
    assert all((int(a) ^ int(b)).bit_count() <= 3 for a, b in zip(u, v))
    links = [(int(a), int(b)) for a in fp for b in fp if a < b and (int(a) ^ int(b)).bit_count() <= 3]
    nodes = list(map(int, fp))
    assert components(nodes, list(zip(map(int, u), map(int, v), strict=True))) == components(nodes, links)


def test_counters_stop_at_the_radius():
    planes = np.zeros((64, 1), np.uint64)
    for lane in range(64):  # lane k has its lowest k bits set
        for b in range(lane):
            planes[b, 0] |= np.uint64(1 << lane)
    near = within_radius(planes, np.array([0], np.uint64), np.array([0]), np.array([2**64 - 1], np.uint64))
    assert int(near[0]) == 0b1111


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(0, 200)] + [(300, 301), (301, 300), (400, 400)]
    found = connected_components(spark.createDataFrame(chain, "u long, v long"), 7)
    assert dict(map(tuple, found.collect())) == {i: 0 for i in range(1, 201)} | {301: 300}


def test_a_star_of_many_leaves(spark):
    leaves = spark.range(1, 100_001).selectExpr("id as u", "0L as v")
    hub = leaves.union(leaves.selectExpr("200000 - u as u", "300000L as v")).repartition(40, "u")
    found = connected_components(hub, 3000)
    nodes = set(range(1, 100_001)) | set(range(100_000, 200_000)) | {300_000}
    assert {r["node"] for r in found.collect()} == nodes and found.agg({"component": "max"}).first()[0] == 0


def test_null_ids_take_part(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "quite another text of words"), (2, None)], "doc_id long, text string")
    found = sorted(((r["doc_id"], r["component_id"]) for r in simhash_components(docs).collect()), key=str)
    assert found == sorted([(None, 5), (5, 5), (None, None), (2, 2)], key=str)


def test_blocks_follow_the_number():
    assert [simhash.blocks_for(n) for n in (0, 10**6, 10**9, 10**11, 10**13)] == [5, 5, 6, 7, 8]


def test_more_blocks_find_the_same(spark):
    rng = np.random.default_rng(2)
    prints = {int(rng.integers(0, 2**63))}
    for _ in range(60):
        prints.add(next(iter(prints)) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 6), replace=False)))
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = [dict(map(tuple, connected_components(near_links(frame, blocks=b)).collect())) for b in (5, 7)]
    assert found[0] == found[1] and found[0]


def test_shingles_of_pieces():
    text = ("Ein Wort,  noch\tein\n" * 50 + "é" * 30 + " end").encode()
    whole = [run for runs in simhash.shingles(text, 3) for run in runs]
    assert whole == [run for runs in simhash.shingles(text, 3, piece=17) for run in runs]
    words = text.lower().split()
    assert whole == [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    assert list(simhash.shingles(b" A b ", 3, piece=1)) == [[b"a b"]] and list(simhash.shingles(b" \n", 3)) == []
