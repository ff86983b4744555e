from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from tempolith.llm import quality_rules
from tempolith.llm.quality_rules import judge, statistics


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(re.findall("[A-Z]", text))


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper"]
ODD = [None, "", " \n\t", "a", "a b", "a a a a", "a b c a b c a", "é | ü\n\né | ü\n#\r\x0b\x0cx\x1cy z", "x y\nx y\n x y\n\n\n", "w " * 20_000, "𝔘 𝔘 𝔘 b 𝔘 𝔘 𝔘", " lead and trail "]


def test_statistics_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = ODD + [r["text"] for r in docs.collect()]
    rows = statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[n] for n in NAMES) == plain(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_base_and_verdict(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = judge(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    good = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 0 and not r["base_failed"]]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.1


def test_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, kept boolean, level int, n double"
    assert judge(spark.createDataFrame([], schema)).collect() == []
    text = "one two three four five six seven eight nine ten " + " ".join(f"w{i}" for i in range(60))
    rows = judge(spark.createDataFrame([(i % 3, t, None, None, False, 1, 0.5) for i, t in enumerate([text, None, text, ""])], schema)).collect()
    assert sorted(r["kept"] for r in rows) == [False, False, True, True]


def test_distances_equal_a_plain_estimate(spark):
    """The same concentration steps in numpy, on one group, from the same start."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 6)) @ np.triu(rng.normal(size=(6, 6))) + 5
    x[:60] += 30
    frame = spark.createDataFrame([(0, "en", "s", *map(float, r)) for r in x], "level int, a string, b string, " + ", ".join(f"x{i} double" for i in range(6)))
    estimate = quality_rules._first_estimate(frame, 6)
    first = estimate.first()
    center, root = np.array([first[f"m{i}"] for i in range(6)]), np.diag([first[f"l{i}_{i}"] for i in range(6)])
    for _ in range(2):
        estimate = quality_rules._concentrate(frame, estimate, 6)
        d2 = (np.linalg.solve(root, (x - center).T) ** 2).sum(axis=0)
        bins = np.floor(np.log2(d2 + 2.0**-10) * quality_rules.BINS_PER_OCTAVE)
        edge = np.sort(bins)[math.ceil(quality_rules.CORE * len(x)) - 1]
        core = x[bins <= edge]
        widen = quality_rules.CORE / quality_rules._chi2_cdf(quality_rules.chi2_quantile(quality_rules.CORE, 6), 8)
        center, cov = core.mean(axis=0), np.cov(core.T, bias=True) * widen + np.diag(np.square(quality_rules.FLOORS))
        root = np.linalg.cholesky(cov)
    got = np.sort([r["d2"] for r in quality_rules._distances(frame, estimate, 6).collect()])
    assert got == pytest.approx(np.sort((np.linalg.solve(root, (x - center).T) ** 2).sum(axis=0)), rel=1e-6)
    assert (got > 100).sum() >= 60


def test_a_third_of_far_rows_is_rejected(spark):
    """Scattered junk and far copies, each a third of its group, in three of six statistics."""
    rng = np.random.default_rng(4)
    rows = []
    for group, spread in (("scattered", 1.0), ("copies", 0.0)):
        x = rng.normal(size=(1500, 6)) * np.maximum(quality_rules.FLOORS, 0.3)
        far = np.arange(1500) < 510
        x[far] = rng.normal(size=(510, 6)) * spread * 0.3
        x[far, :3] += np.array([6.0, 4.0, 5.0])
        rows += [(0, "en", group, bool(f), *map(float, r)) for f, r in zip(far, x, strict=True)]
    frame = spark.createDataFrame(rows, "level int, a string, b string, far boolean, " + ", ".join(f"x{i} double" for i in range(6)))
    found = quality_rules._distances(frame, quality_rules.estimates(frame, 6), 6)
    limit = quality_rules.SLACK * quality_rules.chi2_quantile(quality_rules.QUANTILE, 6)
    for group in ("scattered", "copies"):
        got = [(r["far"], r["d2"] > limit) for r in found.filter(found["b"] == group).collect()]
        assert np.mean([out for far, out in got if far]) > 0.98
        assert np.mean([out for far, out in got if not far]) < 0.01


def test_small_groups_are_judged_by_larger_ones(spark):
    """A rare source of a large language, and a rare language, beside a large group: each row has its distance."""
    rng = np.random.default_rng(6)
    text = lambda: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(rng.integers(60, 120)))
    rows = [(i, text(), *key) for i, key in enumerate([("en", "s")] * 120 + [("en", "rare")] * 5 + [("es", "s")] * 5)]
    rows += [(200, "$$$$$$$$ ## " * 4 + " ".join(f"${i}#{'&' * 300}" for i in range(900)), "es", "s"), (201, rows[0][1], None, None)]
    found = {r["doc_id"]: r for r in judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(found) == len(rows) and all(r["distance2"] is not None for r in found.values() if not r["base_failed"])
    assert not found[200]["base_failed"] and not found[200]["kept"]
    assert all(r["kept"] for i, r in found.items() if i != 200)
