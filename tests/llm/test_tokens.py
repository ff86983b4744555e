from __future__ import annotations

import base64
import hashlib
import random
import tracemalloc

import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tempolith.llm import bpe, unigram
from tokenizers import Tokenizer, models, pre_tokenizers

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
MODEL = P.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  a  b ", "\n\n\t x\r\n", "x" * 3000, "é" * 500, "'s 'll don't", "日本語のテキスト 한국어 text", "\x1c\x1d a\x85b c\xa0 d", "<unk> <s> <0x0A> ▁▁ ▁a", "𝔘𝔫𝔦 🤖🤖 \U0010ffff", "½ Ⅷ ² ٣٤", "á‍ b", "\x00\x01", "    indent\n        more", "a\u2003\u2003b\u3000c\u1680d\u205fe\u2028\u2029f\u202fg\u200bh\u180ei", "word " * 20_000]


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def uni():
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    tokenizer = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    return tokenizer


def texts(spark):
    return ODD + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(rows)], "doc_id long, text string, n_tokens int, ids string")


def test_round_trip_equals_tiktoken(spark, tik):
    rows = texts(spark)
    found = {r["doc_id"]: r for r in bpe.round_trip(frame(spark, rows), RANKS, P.PATTERN).collect()}
    assert len(found) == len(rows)
    for i, text in enumerate(rows):
        ids = tik.encode_ordinary(text or "")
        assert found[i]["n_tokens"] == len(ids), text
        assert found[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), text
        assert found[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_encoded_and_decoded_tables(spark, tik):
    rows = texts(spark)
    encoded = bpe.encode_documents(frame(spark, rows), RANKS, P.PATTERN)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == {i: tik.encode_ordinary(t or "") for i, t in enumerate(rows)}
    assert {r["doc_id"]: r["text"] for r in bpe.decode_documents(encoded, RANKS, piece=3).collect()} == {i: t or "" for i, t in enumerate(rows)}


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    transducer, cut = bpe.load(RANKS), bpe.splitter(P.PATTERN)
    ids, _ = transducer.encode(cut(text))
    assert b"".join(transducer.tokens[i] for i in ids) == text.encode()
    assert ids == [i for w in cut(text) for i in ([transducer.ranks[w.encode()]] if w.encode() in transducer.ranks else transducer.merge(w.encode()))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=4), max_size=12))
def test_incremental_decoder_equals_python(pieces):
    tokens = list(dict.fromkeys(pieces))
    ids = [tokens.index(p) for p in pieces]
    for piece in (1, 2, 100):
        assert "".join(bpe.decode_stream(ids, tokens, {}, piece)) == b"".join(pieces).decode(errors="replace")


def test_random_bytes_equal_merging():
    transducer, rng = bpe.load(RANKS), random.Random(7)
    for _ in range(400):
        word = bytes(rng.choice(b"abcehinorst \xc3\xa9\xe3\x81\x82") for _ in range(rng.randrange(1, 40)))
        if word not in transducer.ranks:
            assert transducer.encode_word(word) == transducer.merge(word)


def test_neighbours_equal_merging():
    own, rng = bpe.load(RANKS), random.Random(5)
    for _ in range(20_000):
        left, right = rng.randrange(20_000), rng.randrange(20_000)
        assert own._stand_together(left, right) == (own.merge(own.tokens[left] + own.tokens[right]) == [left, right])
    small = bpe.Transducer({w: i for i, w in enumerate([b"a", b"b", b"c", b"bc", b"ab", b"abc", b"aa", b"aaa", b"bcc", b"cab", b"abab"])})
    for left in range(len(small.tokens)):
        for right in range(len(small.tokens)):
            assert small._stand_together(left, right) == (small.merge(small.tokens[left] + small.tokens[right]) == [left, right])
    for _ in range(3000):
        word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 14)))
        if word not in small.ranks:
            assert small.encode_word(word) == small.merge(word)


def test_forgetting_states_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_STATES", 5)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 3)
    monkeypatch.setattr(bpe, "WINDOW", 64)
    own = bpe.Transducer(bpe.load(RANKS).ranks)
    word = b"unforgettablelongword" * 30
    assert own.encode_word(word) == own.merge(word) == own.encode_word(word)
    rng = random.Random(8)
    for _ in range(50):
        word = bytes(rng.choice(b"abcehinorst") for _ in range(300))
        assert own.encode_word(word) == own.merge(word)


def test_counts_equal_the_library(spark, uni):
    rows = texts(spark)
    found = {r["doc_id"]: r["n_tokens"] for r in unigram.token_counts(frame(spark, rows), MODEL).collect()}
    for i, text in enumerate(rows):
        assert found[i] == len(uni.encode(text or "", add_special_tokens=False).ids), text


def test_ties_and_unknowns():
    """Small vocabularies full of ties, against the library, with unknown characters fused."""
    rng = random.Random(11)
    for _ in range(60):
        names = {"<unk>"} | {"".join(rng.choice("ab▁") for _ in range(rng.randrange(1, 4))) for _ in range(8)}
        pieces = [("<unk>", 0.0)] + [(n, float(-rng.randrange(4))) for n in sorted(names - {"<unk>"})]
        library = Tokenizer(models.Unigram(pieces, unk_id=0))
        library.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
        counter = unigram.Counter(pieces)
        for _ in range(20):
            text = "".join(rng.choice("aabb c") for _ in range(rng.randrange(1, 14)))
            assert counter.text(text)[1] == len(library.encode(text).ids), (pieces, text)


def test_long_words_equal_short_ones(monkeypatch):
    """Words whose places go round a ring, and texts cut into pieces, against the same without either."""
    rng = random.Random(12)
    counters = [unigram.load(MODEL)]
    for _ in range(12):
        names = {"<unk>"} | {"".join(rng.choice("ab▁") for _ in range(rng.randrange(1, 5))) for _ in range(8)}
        counters.append(unigram.Counter([("<unk>", 0.0)] + [(n, -rng.choice([0.0, 1.0, 2.0, 0.3])) for n in sorted(names - {"<unk>"})]))
    samples = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 200))) for alphabet in ("aabbc", "ab c", "the and é日\n▁ ") for _ in range(25)]
    expected = [[c.text(t) for t in samples] for c in counters]
    for c in counters:
        c.cache.clear()
        c.older.clear()
    monkeypatch.setattr(unigram, "WHOLE_WORD", 1)
    monkeypatch.setattr(unigram, "PIECE", 7)
    assert [[c.text(t) for t in samples] for c in counters] == expected


def test_words_side_by_side_equal_one_by_one(spark, monkeypatch):
    """Small vocabularies with bytes, full of ties, in small blocks and sections."""
    rng = random.Random(13)
    for name, value in (("COMMON", 3), ("ABREAST", 7), ("SHORT", 9), ("TOGETHER", 40), ("PIECE", 11)):
        monkeypatch.setattr(unigram, name, value)
    for _ in range(40):
        names = {"<unk>", "\n"} | {f"<0x{b:02X}>" for b in range(256)} | {"".join(rng.choice("abé▁") for _ in range(rng.randrange(1, 5))) for _ in range(10)}
        counter = unigram.Counter([("<unk>", 0.0)] + [(n, float(-rng.randrange(4))) for n in sorted(names - {"<unk>"})])
        assert counter.abreast is not None
        rows = [t for t in ODD if t is None or len(t) < 100] + ["".join(rng.choice("aabb é日\n▁") for _ in range(rng.randrange(60))) for _ in range(20)]
        assert list(zip(*counter.texts(None if t is None else t.encode() for t in rows), strict=True)) == [counter.text(t or "") for t in rows]


def test_new_words_are_not_segmented_one_by_one(spark, uni, monkeypatch):
    counter, rows = unigram.load(MODEL), texts(spark)
    calls = []
    monkeypatch.setattr(counter, "word", lambda word: calls.append(word) or unigram.Counter.word(counter, word))
    found = list(unigram.counted(iter([pa.record_batch([pa.array(range(len(rows))), pa.array(rows, pa.string())], ["doc_id", "text"])]), MODEL))
    assert found[0]["n_tokens"].to_pylist() == [len(uni.encode(t or "", add_special_tokens=False).ids) for t in rows]
    assert all(len(word) > unigram.SHORT for word in calls) and len(calls) < 20


def test_a_very_long_word_takes_little_memory():
    counter = unigram.load(MODEL)
    text = "abcdefghij" * 60_000
    tracemalloc.start()
    counted = counter.text(text)[1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * len(text) and abs(counted - 10 * counter.text(text[: len(text) // 10])[1]) < 20


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(none, RANKS, P.PATTERN).collect() == [] and unigram.token_counts(none, MODEL).collect() == []
