from __future__ import annotations

import corpus_pipeline
import numpy as np
import public_tokenizers
from tempolith.llm import classifier, language, pipeline, unigram

from .test_packing import verify
from .test_near_copies import plain

SF = "/root/testdata/sf0.01"
ODD = [(10_000, None, "en", "src1", 0), (10_001, "", None, None, 0), (10_002, "12 34 ###", "en", "src1", None), (10_003, "日本語のテキスト" * 200, "ja", None, 1600), (None, "the and of in to that is", "en", "src1", 24)]


def test_stages_equal_plain_versions(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = table.union(spark.createDataFrame(ODD, table.schema))
    # language ID
    langs, model = language.learn(docs.filter(~language.held_out()))
    rows = docs.collect()
    kept = pipeline.language_id(spark, docs, SF)
    assert kept.columns == table.columns
    explained = [r for r in rows if language.verdict(None if r["text"] is None else r["text"].encode(), langs, model)[3]]
    assert sorted(map(str, kept.collect())) == sorted(map(str, explained))
    assert not {10_000, 10_001, 10_002} & {r["doc_id"] for r in explained} and len(explained) >= 1000
    # quality classifier
    docs, rows = kept, explained
    trained = classifier.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = pipeline.quality_classifier(spark, docs, SF)
    score = lambda r: trained.score(classifier.text_view(r["text"].encode())[None], classifier.meta_view(r["lang"], r["source"], r["n_chars"])[None])[0]
    good = [r for r in rows if score(r) >= classifier.KEEP]
    assert kept.columns == table.columns and sorted(map(str, kept.collect())) == sorted(map(str, good))
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stays = {r["doc_id"] for r in good}
    assert np.mean([i in stays for i, q in truth.items() if q == 1]) > 0.99
    # near-duplicates
    docs = spark.createDataFrame(good + good[:3], table.schema)
    kept = pipeline.simhash_near_dedup(spark, docs, SF)
    first = {i for i, root in plain([(r["doc_id"], r["text"]) for r in good if r["doc_id"] is not None]).items() if i == root}
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(first)
    # packing
    rows = kept.collect()
    counter = unigram.load(public_tokenizers.path("piece_bpe_32k.model"))
    packed = pipeline.best_fit_packing(spark, kept, SF).collect()
    verify(packed, {r["doc_id"]: counter.text(r["text"])[1] for r in rows}, (512, 1024, 2048, 4096, 8192))


def test_run_applies_the_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "simhash_near_dedup", "best_fit_packing"]
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert 100 < len({r["doc_id"] for r in packed}) < 200
