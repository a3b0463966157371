import itertools
import time
import zlib

import numpy as np
import pytest

from bazarlytics.llm import language
from bazarlytics.llm.queries import QUERIES


def brute_path(scores, penalty):
    """The best sum over all label sequences, by trying every one."""
    n, width = scores.shape
    value = lambda p: sum(scores[i, k] for i, k in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:]))
    return max(value(p) for p in itertools.product(range(width), repeat=n)), value


def plain_viterbi(scores, penalty):
    best = scores[0].copy()
    for s in scores[1:]:
        best = np.maximum(best, best.max() - penalty) + s
    return best.max()


def value(scores, path, penalty):
    return scores[np.arange(len(path)), path].sum() - penalty * (np.diff(path) != 0).sum()


@pytest.mark.parametrize("block", [3, 64])
def test_best_path(monkeypatch, block):
    monkeypatch.setattr(language, "BLOCK", block)
    rng = np.random.default_rng(block)
    lengths = np.array([1, 0, 5, 6, 7, 200, 3, 64])
    scores = rng.integers(-9, 1, (lengths.sum(), 3)).astype(np.float32)
    path = language.best_path(scores, lengths, 6.0)
    for low, n in zip(np.cumsum(lengths) - lengths, lengths):
        if n:
            own = scores[low : low + n]
            assert value(own, path[low : low + n], 6.0) == pytest.approx(plain_viterbi(own, 6.0))
            if n <= 7:
                assert plain_viterbi(own, 6.0) == pytest.approx(brute_path(own, 6.0)[0])


def test_query_on_held_out_rows(spark, documents):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op5_viterbi_language"](spark, folder).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.96 * len(held)


def model(spark):
    lines = [("en", "the house and the garden that they were with"), ("fr", "les maisons et le jardin qui étaient avec nous"), ("ru", "дом и сад которые были там")]
    df = spark.createDataFrame([(k, t) for k, t in lines for _ in range(5)], "lang string, text string")
    return language.fit(df)


def test_spans_of_mixed_text(spark):
    text = "The garden and the house. 12 " * 3 + "le jardin et les maisons étaient " * 3 + "сад и дом 漢字"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = language.identify(df, model(spark), penalty=4.0, spans=True).collect()
    assert [s.lang for s in row.spans] == ["en", "fr", "ru", "und"]
    assert text[row.spans[1].start : row.spans[1].end].startswith("le jardin")
    assert row.lang_pred == "fr"


def test_scripts_decide(spark):
    got = model(spark).score_words(["сад", "garden", "漢"])
    assert got[0][0].argmax() == 2 and got[0][0][0] == language.OUT and got[1].tolist() == [True, True, False]


def test_words_are_cut_at_numerals_at_the_speed_of_letters():
    text = "Abc½déf x²y Ⅳ 一二 \U00010107ß \U0001d7d8z 12ab_c ก๑ข"
    whole = language._LETTERS.findall(text.lower())
    assert language.words_of(text) == whole and "abc" in whole and "一二" in whole
    assert [text[a:b].lower() for a, b in language.word_places(text)] == whole
    assert language.word_places("") == language.words_of("") == []
    long = "the garden and the house " * 20_000
    begun = time.process_time()
    language._RUNS.findall(long)
    plain, begun = time.process_time() - begun, time.process_time()
    assert len(language.words_of(long)) == len(language.word_places(long)) == 100_000
    assert time.process_time() - begun < 15 * plain + 0.1


def test_odd_rows(spark, table):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 34 -", None), (4, "½ ² ¼ Ⅳ", None), (7, "漢字 сад", None), (5, "the " * 50_000, "en"), (6, "und der " * 9, "de"), (6, "und der " * 9, "de"), (None, "the", None)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows * 1], "doc_id long, text string, lang string, source string, score double")
    more = spark.createDataFrame([(i, "the and that", "en", "x", 1.0) for i in range(100, 110)] + [(i, "und der die", "de", "x", 1.0) for i in range(110, 120)], df.schema)
    got = QUERIES["op5_viterbi_language"](spark, table(documents=df.union(more))).collect()
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert len(got) == len(rows) + 20 and all(r.held_out is not None for r in got)
    assert by[1] == by[2] == by[3] == by[4] == ("und", 0.0) and by[7] in (("de", 0.0), ("en", 0.0)) and by[5] == ("en", 1.0) and by[6] == ("de", 1.0)
    assert QUERIES["op5_viterbi_language"](spark, table(documents=df.limit(0))).collect() == []
    unlabelled = df.selectExpr("doc_id", "text", "cast(null as string) lang", "source", "score")
    assert {r.lang_pred for r in QUERIES["op5_viterbi_language"](spark, table(documents=unlabelled)).collect()} == {"und"}
