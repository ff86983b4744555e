from __future__ import annotations

import re
from collections import defaultdict
from itertools import permutations

from hypothesis import given, settings
from hypothesis import strategies as st
from tempolith.llm import filter_audit
from tempolith.llm.filter_audit import Chains, audit, failed, repeated_ids

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, part string, n string"
LABELS = "doc_id long, quality int, toxic int, note string"


def plain_failures(text):
    words = WORD.findall(text)
    found = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words))
    found += "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
    return found


def plain_audit(docs, labels):
    fails = []
    for doc_id, text, lang in docs:
        t = text or ""
        again = doc_id is not None and any(i is not None and i < doc_id and (u or "") == t for i, u, _ in docs)
        mine = [row for row in labels if row[0] is not None and row[0] == doc_id]
        fails.append((lang or "", plain_failures(t) + "E" * again, any(r[1] == 1 for r in mine), any(r[2] == 1 for r in mine)))
    out = []
    for part in {f[0] for f in fails}:
        rows = [f for f in fails if f[0] == part]
        removed_by = defaultdict(int)
        lines = []
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[1]]
                gone = sum(f in r[1] for r in rows) - len(here)
                left = [r for r in left if f not in r[1]]
                removed_by[f] += len(here)
                lines.append(["".join(order), step, len(left), len(here), gone, sum(r[1] == f for r in rows), sum(r[2] for r in here), sum(r[3] for r in here), f])
        out += [(part, *line[:-1], removed_by[line[-1]]) for line in lines]
    return sorted(out)


def test_audit_of_documents_equals_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    found = sorted(map(tuple, audit(docs, labels).collect()))
    assert found == plain_audit([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], [tuple(r) for r in labels.collect()])


def test_odd_rows(spark):
    long = "Word " * 30_000
    fine = " ".join(f"w{i}" for i in range(100))
    docs = [(1, None, "en"), (2, "", None), (3, "", ""), (3, "", ""), (4, fine, "en"), (5, fine, "de"), (5, fine, "de"), (5, long, "en"), (5, long, "en"), (None, fine, "en"), (None, None, None), (None, fine, "en"), (7, long, None), (8, "é" * 89 + "ABCDEFGHIJK", "en"), (9, "é" * 90 + "ABCDEFGHIJ", "en"), (10, "a b c\x1cd #", "en"), (-4, fine, "de")] + [(100 + i, "copy", "en") for i in range(60)]
    labels = [(4, 1, 0, ""), (4, 0, 1, ""), (5, None, None, ""), (None, 1, 1, ""), (104, 1, None, ""), (105, 0, 1, ""), (999, 1, 1, "")]
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS).repartition(5)
    marks = spark.createDataFrame(labels, LABELS)
    for limit in (1, 1 << 20):
        assert sorted(map(tuple, audit(frame, marks, chain_bytes=limit).collect())) == plain_audit(docs, [r[:3] for r in labels])
    assert sorted(repeated_ids(frame).collect()) == [2, 3, 4, 5, 7, *range(101, 160)]
    assert audit(frame.limit(0), marks).collect() == []
    assert len(audit(frame, marks.limit(0)).collect()) == 600 * 3


def test_equal_fingerprints_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(filter_audit.xxhash, "xxh64_intdigest", lambda *_: 7)
    own = Chains()
    assert own.add(7, b"a", 5, {"f": 1}) is None and own.add(7, b"b", 1, {"f": 1}) is None
    assert own.add(7, b"a", 3, {"g": 1}) == (5, {"f": 1}) and own.add(7, b"b", 2, {"h": 1}) == (2, {"h": 1})
    assert sorted(own.drain()) == [(7, b"a", 3, {"g": 1}), (7, b"b", 1, {"f": 1})]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB #\t\n\x1c é", max_size=300))
def test_failures_of_a_text(text):
    mask = failed(text.encode())
    assert "".join(f for i, f in enumerate("ABCD") if mask >> i & 1) == plain_failures(text)
