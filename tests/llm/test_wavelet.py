import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bazarlytics.llm import wavelet
from bazarlytics.llm.queries import QUERIES
from bazarlytics.llm.tokens import Encoder, default_path

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
_CHARS = st.text(st.one_of(st.sampled_from("aé ü\n\t.'sS½²ªⅣ中ﬁİΣς\x1c\x85\xa0é<|>"), st.characters(codec="utf-8")), max_size=40)
TEXT = st.lists(st.one_of(_CHARS, st.sampled_from(["<|endoftext|>", "<|EndOfText|>"])), max_size=4).map("".join)


@pytest.mark.parametrize("name", NAMES)
def test_encoder_equals_the_library(name, documents):
    plain = Tokenizer.from_file(default_path(name))
    texts = [r.text or "" for r in documents.select("text").collect()]
    texts += ["", "It's they're I'LL 3½ x²", "a <|endoftext|> b", "<|ENDOFTEXT|>x", "<|startoftext|><|endoftext|>", "<|endoftext", "a\n\n b  \n", "naïve café", "ΣΑΣ ς", "a\x1cb\x85c"]
    got = Encoder(default_path(name), kept=3000).encode(texts)
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
def test_encoder_on_any_text(name):
    plain = Tokenizer.from_file(default_path(name))
    own = Encoder(default_path(name))

    @settings(max_examples=300, deadline=None)
    @given(TEXT)
    def check(text):
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids

    check()


def test_shard_answers(monkeypatch):
    monkeypatch.setattr(wavelet, "CHUNK", 64)
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 40, 1000).astype(np.uint32)
    shard = wavelet.Shard(wavelet.pack(ids, [1, 2], [400, 600]))
    assert shard.all_ids().tolist() == ids.tolist()
    assert [shard.access(i) for i in range(0, 1000, 37)] == ids[::37].tolist()
    for token in (0, 7, 39, 40, 1 << 20):
        places = np.flatnonzero(ids == token)
        assert shard.count(token) == len(places)
        assert shard.count(token, 100, 517) == ((places >= 100) & (places < 517)).sum()
        assert [shard.locate(token, k) for k in range(len(places))] == places.tolist()
        with pytest.raises(IndexError):
            shard.locate(token, len(places))
    assert wavelet.Shard(wavelet.pack(np.zeros(0, np.uint32), [], [])).all_ids().tolist() == []


def test_all_ids_in_little_memory():
    rng = np.random.default_rng(1)
    for most in (1 << 16, 1 << 20):
        ids = rng.integers(0, most, 500_000).astype(np.uint32)
        data = wavelet.pack(ids, [1], [len(ids)])
        tracemalloc.start()
        got = wavelet.Shard(data).all_ids()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got.dtype == np.uint32 and (got == ids).all()
        assert peak < 20 * len(ids)


def expected(rows, name, end):
    plain = Tokenizer.from_file(default_path(name))
    for key, text in rows:
        yield key, [*plain.encode(text or "", add_special_tokens=False).ids, end]


def test_query_against_the_library(spark, folder, documents):
    rows = [(r.doc_id, r.text) for r in documents.orderBy("doc_id").collect()]
    want, start = [], 0
    for key, ids in expected(rows, NAMES[0], 1):
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = QUERIES["op2_wavelet_token_files"](spark, folder)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_small_shards_and_odd_rows(spark, table, tmp_path):
    rows = [(3, None), (1, ""), (2, "same words"), (2, "same words"), (None, "x"), (7, "long " * 30_000)]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, start string")
    files = wavelet.write_shards(df, default_path(NAMES[0]), str(tmp_path / "out"), shard_tokens=2)
    assert files.count() >= 4
    got = sorted((r.start, r.doc_id, len(r.ids) // 4) for r in wavelet.read_shards(files).collect())
    assert got == [(0, None, 2), (2, 1, 1), (3, 2, 3), (6, 2, 3), (9, 3, 1), (10, 7, 30_001)]
    assert QUERIES["op2_wavelet_token_files"](spark, table(documents=df.limit(0))).collect() == []


def test_lower_cased_words_need_no_chunks():
    own = Encoder(default_path("word_bpe_49k.json"), kept=2)
    texts = [f"Word{c} word{c}\n\tit's 'LL 'q {c}{c}1é" for c in ".,;:!?)"] + ["", "  ", "a\x85b  'twas"]
    library = own.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [x.ids for x in library]
    assert not own.first and not own.rest and len(own.known_words) == 6  # a word is kept once, whatever stands beside it
