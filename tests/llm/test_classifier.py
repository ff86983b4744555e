from __future__ import annotations

import numpy as np
from tempolith.llm import classifier
from tempolith.llm.classifier import classify, score, train

DOCS = "doc_id long, text string, lang string, source string, kept int"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = train(docs, labels.filter("doc_id % 3 <> 1"))
    truth = {r["doc_id"]: r["quality"] for r in labels.filter("doc_id % 3 = 1").collect()}
    rows = [r for r in score(docs, model).collect() if r["doc_id"] in truth]
    good = [r["kept"] for r in rows if truth[r["doc_id"]] == 1]
    bad = [r["kept"] for r in rows if truth[r["doc_id"]] == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.15
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_views_teach_each_other(spark):
    """The text tells the class in a few ways, a handful of labels only of some; sources tell it too, and teach the rest."""
    rng = np.random.default_rng(0)
    words = [["alpha", "gamma", "sigma"], ["###", "$$$", "|||"]]
    rows, truth = [], {}
    for i in range(600):
        good = i % 2 == 0
        way = 0 if i < 24 else int(rng.integers(0, 3))  # labels know the first way alone
        text = " ".join(words[not good][way] if rng.random() < 0.3 else "the of and in"[: int(rng.integers(3, 13))] for _ in range(60))
        rows.append((i, text, "en", f"{'good' if good else 'bad'}{rng.integers(0, 3)}", len(text)))
        truth[i] = int(good)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, truth[i]) for i in range(24)], "doc_id long, quality int")
    views = classifier._batch_views([t.encode() for _, t, *_ in rows], *zip(*[r[2:] for r in rows], strict=True))
    y = np.array(list(truth.values()))
    right = []
    for rounds in (0, 4):
        model = train(docs, labels, rounds=rounds, pseudo=60, confident=0.8)
        right.append(np.mean((model.text.logit(views[0])[24:] > 0) == y[24:]))
    assert right[1] > right[0] + 0.03 and right[1] > 0.9


def test_all_unlabelled_documents_are_judged(spark, monkeypatch):
    rows = [(i, "a good plain text " * 20 if i % 2 else "&&& ### " * 50, "en", f"s{i % 2}", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    inner = classifier._judge
    monkeypatch.setattr(classifier, "_judge", lambda rows, model: seen.append(rows.count()) or inner(rows, model))
    model = train(docs, labels, rounds=2, pseudo=5, confident=0.6)
    assert seen == [300, 300] and model is not None


def test_query_equals_plain_version(spark):
    """The whole of training and scoring, with lists instead of tables."""
    sf = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    docs = sorted((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in table.collect())
    goal = {r["doc_id"]: r["quality"] for r in labels.collect()}
    views = classifier._batch_views([d[1].encode() for d in docs], *zip(*[d[2:] for d in docs], strict=True))
    ids = [d[0] for d in docs]
    known = np.array([i in goal for i in ids])
    y = np.array([goal[i] for i in ids if i in goal], float)
    order = {r["doc_id"]: r["h"] for r in table.selectExpr("doc_id", "xxhash64(doc_id) as h").collect()}
    labelled = tuple(v[known] for v in views)
    model, given = classifier.fit(labelled, y), ({}, {})
    for _ in range(classifier.ROUNDS):
        chances = [1 / (1 + np.exp(-np.clip(m.logit(v), -30, 30))) for m, v in zip(model.views(), views, strict=True)]
        more = False
        for k in (0, 1):
            for label in (0, 1):
                sure = chances[k] if label else 1 - chances[k]
                ranked = sorted((at for at in range(len(ids)) if not known[at] and sure[at] >= classifier.CONFIDENT and ids[at] not in given[1 - k]), key=lambda at: (-sure[at], order[ids[at]]))
                for at in ranked[: classifier.PSEUDO]:
                    given[1 - k].setdefault(ids[at], (at, label))
                    more = True
        if not more:
            break
        model = classifier.fit(labelled, y, tuple((v[[at for at, _ in g.values()]], np.array([label for _, label in g.values()], float)) for v, g in zip(views, given, strict=True)))
    expected = dict(zip(ids, model.score(*views), strict=True))
    found = classify(table, labels).collect()
    assert len(found) == len(docs)
    differ = [abs(r["score"] - expected[r["doc_id"]]) for r in found]
    assert max(differ) < 0.05 and np.mean([d > 1e-3 for d in differ]) < 0.02


def test_odd_rows(spark):
    rows = [(i, "a good plain text " * 20, "en", "s", 1) for i in range(20)] + [(i, "&&& ### " * 50, "en", "s", 1) for i in range(20, 40)]
    rows += [(40, None, None, None, 1), (41, "", "xx", "t", 1), (42, "long text " * 50_000, None, "s", 1), (None, "x", "en", "s", 1), (0, "a good plain text " * 20, "en", "s", 1)]
    labels = spark.createDataFrame([(i, int(i < 20), 0) for i in range(40)] + [(40, None, 0), (None, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    found = classify(spark.createDataFrame(rows, DOCS), labels).collect()
    assert len(found) == len(rows)
    kept = {r["doc_id"]: r["kept"] for r in found}
    assert all(kept[i] for i in range(20)) and not any(kept[i] for i in range(20, 40))


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "x", "en", "s", 1)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [tuple(r) for r in classify(docs, none).collect()] == [(1, 0.5, True)]
    assert classify(docs.limit(0), none).collect() == []


def test_pieces_add_up(monkeypatch):
    text = "é word\n".encode() * 5000
    whole = classifier.text_view(text)
    monkeypatch.setattr(classifier, "PIECE", 777)
    assert np.allclose(classifier.text_view(text), whole)


def test_metadata_knows_nothing_of_the_text():
    assert np.array_equal(classifier.meta_view("en", None, 5), classifier.meta_view("en", None, 5))
    assert not np.array_equal(classifier.meta_view("en", "a", 5), classifier.meta_view("en", None, 5))
    assert classifier.meta_view(None, None, None)[:-1].sum() == 0
