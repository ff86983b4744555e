from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tempolith.llm.fingerprints import digest, digests, edit_digests, edited, likeness

DOCS = "doc_id long, text string, place int, fingerprint string"


def plain_digest(text: bytes) -> str:
    counts = Counter()
    for i in range(len(text)):
        a, b, c = (text[(i + k) % len(text)] for k in (0, 3, 7))
        value = a << 16 | b << 8 | c
        counts[((value ^ value >> 15) * 0x9E3779B1 & 0xFFFFFFFF) >> 24] += 1
    ordered = sorted(counts[b] for b in range(256))
    edges = [ordered[63], ordered[127], ordered[191]]
    codes = [sum(counts[b] > e for e in edges) for b in range(256)]
    packed = "".join(f"{codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3]:02x}" for i in range(0, 256, 4))
    return f"{min(255, round(8 * math.log2(1 + len(text)))):02x}" + packed


def plain_likeness(a: str, b: str) -> float:
    score = min(64, 2 * max(0, abs(int(a[:2], 16) - int(b[:2], 16)) - 1))
    for x, y in zip(bytes.fromhex(a[2:]), bytes.fromhex(b[2:]), strict=True):
        for shift in (0, 2, 4, 6):
            score += (0, 1, 2, 6)[abs((x >> shift & 3) - (y >> shift & 3))]
    return max(0.0, 1 - score / 416)


def plain_rows(ordered):
    out = []
    for at, (doc_id, text) in enumerate(ordered):
        after = ordered[(at + 1) % len(ordered)][1] or ""
        text = text or ""
        half = len(text) // 2
        changed = "".join([*list(text)[: len(text) - half], *list(after)[:half]])
        own, other, following = (plain_digest(t.encode()) for t in (text, changed, after))
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, other, plain_likeness(own, other), plain_likeness(own, following)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:])))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=400))
def test_digest_of_a_text(text):
    assert digest(text.encode()).hex() == plain_digest(text.encode())


def test_likeness():
    rng = np.random.default_rng(5)
    prints = [digest(rng.integers(97, 123, n, np.uint8).tobytes()) for n in (0, 1, 5, 300, 3000, 3000, 30_000)]
    for a in prints:
        for b in prints:
            assert math.isclose(likeness([a], [b])[0], plain_likeness(a.hex(), b.hex()))
            assert likeness([a], [b])[0] == likeness([b], [a])[0] and (a != b or likeness([a], [b])[0] == 1)
    assert likeness(prints[4:5], prints[5:6])[0] < 0.2


def test_edited_text():
    assert edited("abcdé", "xyz") == "abcxy" and edited("abcdef", "x") == "abcx" and edited("", "xyz") == "" and edited("a", "x") == "a" and edited("ab", "") == "a"


def test_query_equals_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = sorted(map(tuple, edit_digests(docs.repartition(7)).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()))
    expected = plain_rows(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    assert [r[:5] for r in found] == [r[:5] for r in expected]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in expected])
    # an edited text is like its document, the next document is not
    assert np.mean([r[5] > r[6] for r in found]) > 0.95
    assert {tuple(r) for r in digests(docs).collect()} == {(r[0], r[3]) for r in expected}


def test_odd_rows(spark):
    rows = [(None, "no id"), (1, None), (2, ""), (3, "é"), (4, "aé" * 60_000), (5, "ab"), (6, "ab")] + [(7, "same text")] * 500 + [(9, "x y z")]
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], DOCS).repartition(9)
    assert order(map(tuple, edit_digests(frame).collect())) == order(plain_rows(rows))
    assert edit_digests(frame.limit(0)).collect() == []
    one = frame.filter("doc_id = 9")
    assert list(map(tuple, edit_digests(one).collect())) == plain_rows([(9, "x y z")])


def test_rows_of_one_id_are_all_there(spark):
    rows = [(5, f"text {i % 40}") for i in range(400)] + [(1, "first"), (8, "last")]
    found = edit_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert Counter((r["doc_id"], r["fingerprint"]) for r in found) == Counter((i, plain_digest(t.encode())) for i, t in rows)
    # equal rows lie beside each other, so all but one of each follow themselves
    assert sum(r["near_next"] == 1.0 for r in found) >= 360
