from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tempolith.llm import language
from tempolith.llm.store import hash_limit


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = language.identify(docs).collect()
    assert len(rows) == len(truth)
    tested = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in tested) / len(tested) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows) and all(r["explained"] for r in rows)


def test_mixture_finds_both_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, table = language.learn(docs)
    parts = [next(r["text"] for r in docs.filter(f"lang = '{lang}' and n_chars between 3000 and 5000").take(1)) for lang in ("en", "de")]
    chosen, share, *_ = language.infer("\n".join(parts).encode(), table)
    assert {langs[i] for i in chosen} >= {"en", "de"} and all(share[[list(chosen).index(langs.index(x)) for x in ("en", "de")]] > 0.25)


def test_odd_texts(spark):
    rows = [(1, "the thing and the other", "en"), (2, "der die das und", "de"), (3, None, "de"), (4, "", "en"), (5, "123 ### 4", None), (6, "é", None), (7, "der und die " * 20_000, None), (None, "the and", "en"), (2, "der die das und", "de")]
    docs = spark.createDataFrame([(i, t, x, 0.5) for i, t, x in rows], "doc_id long, text string, lang string, score double")
    found = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert [found[i]["lang_pred"] for i in (3, 4, 5)] == ["und"] * 3 and found[3]["score"] == 0
    assert found[6]["lang_pred"] in ("en", "de") and len(found) == 8


def test_empty_table(spark):
    assert language.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
    untaught = language.identify(spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")).first()
    assert (untaught["lang_pred"], untaught["score"]) == ("und", 0.0)


def test_sampling_rates_never_reach_zero():
    for n in (10, 4000, 10**6, 4 * 10**9 + 1, 10**10, 10**15):
        expected = n * (hash_limit(n, 4000) + 2**63 + 1) / 2**64
        assert 0.99 * min(n, 4000) <= expected <= 1.01 * min(n, 4000)


def test_every_language_is_learned(spark):
    rows = [(i, f"words of {i % 5} and more", f"x{i % 5}") for i in range(50)] + [(100 + i, f"{chr(97 + i) * 3}ing rare{chr(97 + i)}", f"rare{i}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, table = language.learn(docs)
    assert len(langs) == 14 and table.shape == (14, language.BUCKETS)
    # a smaller model has coarser buckets, not fewer languages
    langs, table = language.learn(docs, cells=14 * 1500)
    assert len(langs) == 14 and table.shape == (14, 1024)
    found = {r["id"]: r["lang_pred"] for r in language.predict(docs, langs, table).collect()}
    assert all(found[100 + i] == f"rare{i}" for i in range(9))
    with pytest.raises(ValueError):
        language.learn(docs, cells=14 * 200)
    assert language.buckets_for(256) == language.BUCKETS and language.buckets_for(257) == language.BUCKETS // 2 and language.buckets_for(1) == language.BUCKETS


def plain_infer(text, table):
    """EM and the choice of the set in plain Python, n-gram by n-gram."""
    squeezed = " " + " ".join("".join(c if c.isascii() and c.isalpha() or not c.isascii() else " " for c in re.sub("[A-Z]", lambda m: m[0].lower(), text)).split()) + " "
    raw = squeezed.encode()
    grams = Counter(((a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF) >> 16 for a, b, c in zip(raw, raw[1:], raw[2:], strict=False))
    total = sum(grams.values())

    def mixture(rows):
        share = {r: 1 / len(rows) for r in rows}
        for _ in range(language.EM_STEPS if len(rows) > 1 else 0):
            new = dict.fromkeys(rows, 0.0)
            for g, n in grams.items():
                at = sum(share[r] * float(table[r, g]) for r in rows)
                for r in rows:
                    new[r] += n * share[r] * float(table[r, g]) / at / total
            done = max(abs(new[r] - share[r]) for r in rows) < 1e-3
            share = new
            if done:
                break
        return share, sum(n * math.log(sum(share[r] * float(table[r, g]) for r in rows)) for g, n in grams.items())

    among_all, _ = mixture(list(range(len(table))))
    order = sorted(among_all, key=lambda r: (-among_all[r], r))
    best = mixture(order[:1])
    for size in range(2, len(order) + 1):
        fresh = mixture(order[:size])
        if (fresh[1] - best[1]) / 3 <= language.PENALTY * math.log(total) / 2:
            break
        best = fresh
    first = max(best[0], key=lambda r: (best[0][r], -order.index(r)))
    return first, set(best[0]), (total / 3 * among_all[first] + 1) / (total / 3 + len(table))


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars < 1500").limit(150)
    mixed = [(20_000 + i, f"{a['text']} {b['text']}", None) for i, (a, b) in enumerate(zip(docs.filter("lang = 'en'").take(10), docs.filter("lang = 'fr'").take(10), strict=True))]
    docs = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(mixed, "doc_id long, text string, lang string")).cache()
    langs, table = language.learn(docs.filter(~language.held_out()))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = language.identify(docs).collect()
    assert len(found) == len(texts)
    for r in found:
        first, chosen, score = plain_infer(texts[r["doc_id"]], table)
        assert (r["lang_pred"], {langs.index(x) for x in r["languages"].split(",")}) == (langs[first], chosen)
        assert abs(r["score"] - score) < 1e-6
    assert len({round(r["score"], 3) for r in found}) > 20


def test_em_recovers_proportions():
    rng = np.random.default_rng(0)
    table = rng.dirichlet(np.full(50, 0.3), size=3) + 1e-6
    count = rng.multinomial(200_000, 0.7 * table[0] / table[0].sum() + 0.3 * table[2] / table[2].sum()).astype(float)
    share, _ = language._mixture(table, count)
    assert np.allclose(share, [0.7, 0, 0.3], atol=0.05)
