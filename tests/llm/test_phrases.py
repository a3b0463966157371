import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from bazarlytics.llm import phrases as P

CASE = {c: c + 32 for c in range(65, 91)}


def counts_of(rows, longest=5):
    """Occurrences of every phrase, and of all words, by language."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(CASE)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    return counts, totals


def brute(rows, least, longest=5, top=2000):
    counts, totals = counts_of(rows, longest)
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if a >= least and " " in p}
        inside = defaultdict(int)
        for p, a in often.items():
            words = p.split(" ")
            for k in range(2, len(words)):
                for i in range(len(words) - k + 1):
                    sub = " ".join(words[i : i + k])
                    inside[sub] = max(inside[sub], a)
        rows_ = []
        for p, a in often.items():
            words = p.split(" ")
            cuts = []
            for k in range(1, len(words)):
                l, r = f[" ".join(words[:k])], f[" ".join(words[k:])]
                cuts.append((1000 * a * totals[lang] // (l * r), k, l, r))
            score, _, l, r = min(cuts)
            if inside[p] < a:
                rows_.append((-score, -a, p.encode(), p, l, r))
        for rank, (score, a, _, p, l, r) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p, -a, l, r, totals[lang], -score))
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in P.collocations(df, **options).collect())


@pytest.fixture(scope="module")
def documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return df, [(r.lang, r.text) for r in df.collect()]


@pytest.mark.parametrize("options", [{}, {"share": 0.02}, {"share": 0.5, "leap_share": 0}, {"share": 0.0}, {"leap_share": 9, "share": 0.05}])
def test_every_way_through_finds_the_same(documents, options):
    df, rows = documents
    assert mined(df, least=8, **options) == brute(rows, 8)


def test_counts_are_whole(documents):
    df, rows = documents
    counts, totals = counts_of(rows)
    found = P.frequent_phrases(df, least=6).collect()
    assert {(r.lang, r.phrase): r.n for r in found if r["size"]} == {(l, p): n for l, f in counts.items() for p, n in f.items() if n >= 6}
    assert len([r for r in found if r["size"]]) == len({(r.lang, r.phrase) for r in found if r["size"]})


def test_border_failures_grow_level_by_level(spark):
    """A phrase of five words that no sampled document has."""
    rows = [("x", f"alpha beta gamma delta epsilon. word{i}") for i in range(30)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    assert {p for _, _, p, *_ in mined(df, least=20, share=0.0, leap_share=0)} == {"alpha beta gamma delta epsilon"}
    assert mined(df, least=20, share=0.0, leap_share=0) == brute(rows, 20) == mined(df, least=20, share=0.9)


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", None, "und", "b"]), " ".join(rng.choice(["The", "the", "É", "é", "x\ty", "a.b", "c;", " q"]) for _ in range(rng.randrange(40)))) for _ in range(300)]
    rows += [("a", None), (None, ""), (None, None), ("b", "the the the the the the the"), ("b", "." * 50)] + [("a", "the É the")] * 20
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "lang string, text string, n int, `phrase.size` string")
    assert mined(df, least=5) == brute(rows, 5)
    assert mined(df.withColumnRenamed("n", "doc_id"), least=9, longest=3, top=3) == brute(rows, 9, 3, 3)
    assert mined(df.limit(0), least=5) == []


def test_long_texts_are_cut_between_pieces(spark, monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choice(["one ", "two ", "three ", "four. "]) for _ in range(3000))
    parts = list(P.portions([text.encode(), b"", b"end no mark " * 40], 300))
    assert b"".join(t for p in parts for row, t in p if row == 0) == text.encode().translate(P._MAP)
    assert sum(len(t) for p in parts for _, t in p if len(p) > 1) >= 0 and max(len(t) for p in parts for row, t in p if row == 0) <= 301
    df = spark.createDataFrame([(1, "x", text)], "doc_id long, lang string, text string")
    assert mined(df, least=30) == brute([("x", text)], 30)


def test_hot_phrase(spark):
    rows = [("x", f"this very passage repeats often, tail{i % 7} ends")for i in range(3000)] + [("y", f"w{i} v{i}") for i in range(2000)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").repartition(8)
    assert mined(df) == brute(rows, 100)


def test_filter_has_all_and_little_else(spark):
    rows = [("x", 1 + i % 3, " ".join(f"w{i}" for _ in range(1 + i % 3))) for i in range(2000)]
    df = spark.createDataFrame(rows, "lang string, size int, phrase string").withColumn("phrase", P.F.col("phrase").cast("binary"))
    bitmap = P.filter_of(df, P.filter_bits(len(rows)))
    for lang, most in (("x", 1.0), ("y", 0.02)):
        words = P.Words([p.encode() for _, _, p in rows], np.zeros(len(rows), np.int64), [lang])
        first, hashed, hits = np.searchsorted(words.text, np.arange(len(rows))), None, []
        for size in (1, 2, 3):
            hashed = words.hashes(size, hashed)
            hits.append(P.member(bitmap, hashed[[f for f, r in zip(first, rows) if r[1] == size]]))
        share = np.concatenate(hits).mean()
        assert share == 1.0 if lang == "x" else share <= most
