from __future__ import annotations

import math
import random
import re

from tempolith.llm.licenses import CONTAINMENT, PHRASES, SLACK, TEMPLATES, digest, scan


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(text, templates=TEMPLATES):
    """All phrases at all places, all templates against a block at every word."""
    w = words(text)
    places = [(i, label) for i in range(len(w)) for p, label in PHRASES if w[i : i + len(p.split())] == p.split()]
    labels, runs = {x for _, x in places}, []
    present = set(w)
    for t, label in templates:
        wanted = set(words(t))
        if len(wanted & present) < CONTAINMENT * len(wanted):
            continue
        size = math.ceil(SLACK * len(words(t)))
        begun = None
        for start in range(max(0, len(w) - size) + 2):
            n = len(wanted.intersection(w[start : start + size])) if start <= max(0, len(w) - size) else 0
            if n >= CONTAINMENT * len(wanted):
                begun = (start, max(n, begun[1] if begun else 0)) if begun is None else (begun[0], max(n, begun[1]))
            elif begun is not None:
                runs.append((begun[0], start - 1, size, label, begun[1] / len(wanted)))
                labels.add(label)
                begun = None
    at = [i for i, _ in places]
    best = max((r[4] for r in runs), default=0.0)
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), best), sorted(runs)


def some_texts():
    rng = random.Random(9)
    texts = [None, "", "MIT License", "mit-license\napache License general public license MIT  LICENSE", "general public", "the MIT licenseé", "license mit", "x " * 20_000 + "Apache License", "é1 MIT\x00License ü"]
    pool = [w for t, _ in TEMPLATES for w in t.split()] + ["lorem", "ipsum", "dolor"]
    for t, _ in TEMPLATES:
        for lead in (0, 20, 23, 24, 25, 47, 60):
            inside = t.split()
            if rng.random() < 0.5:
                inside[rng.randrange(len(inside))] = "other"
            texts.append(" ".join(["filler"] * lead + inside + ["more"] * rng.randrange(60)))
    return texts + [" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 200))) for _ in range(150)]


def test_scan_equals_brute_force(spark):
    texts = some_texts()
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, labels string, n_words int")
    found = scan(docs).cache()
    rows = digest(found).collect()
    assert len(rows) == len(texts)
    expected = [plain(t) for t in texts]
    for r in rows:
        assert tuple(r)[1:] == expected[r["doc_id"]][0], texts[r["doc_id"]]
    for r in found.collect():
        assert sorted(map(tuple, r["matches"])) == expected[r["doc_id"]][1], texts[r["doc_id"]]
    assert sum(r["score"] > 0 for r in rows) > 30


def test_spread_notices_are_found_at_every_offset(spark):
    """A notice with words between its own is met wherever it stands."""
    notice = words(TEMPLATES[-1][0])
    spread = " ".join(w if i % 3 else f"{w} inserted" for i, w in enumerate(notice))
    docs = spark.createDataFrame([(k, " ".join(["filler"] * k) + " " + spread + " rest" * 30) for k in range(60)], "doc_id long, text string")
    assert {r["labels"] for r in digest(scan(docs)).collect()} == {"unlicense"}


def test_random_templates(spark):
    rng = random.Random(4)
    pool = [f"t{i}" for i in range(30)]
    templates = tuple((" ".join(rng.choice(pool) for _ in range(rng.choice([1, 2, 5, 12, 60]))), f"l{k}") for k in range(12))
    texts = [" ".join(rng.choice([*pool, "x", "y"]) for _ in range(rng.randrange(0, 150))) for _ in range(60)]
    found = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates=templates).collect()
    for r in found:
        assert sorted(map(tuple, r["matches"])) == plain(texts[r["doc_id"]], templates)[1]


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = digest(scan(docs)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == {i: plain(t)[0] for i, t in texts.items()}
    assert {x for r in rows for x in r["labels"].split(",")} >= {"mit", "apache", "gpl", "cc-by-nc"}


def test_empty_table(spark):
    assert digest(scan(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
