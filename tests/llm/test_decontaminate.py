import numpy as np
import pytest

from bazarlytics.llm import decontaminate as D
from bazarlytics.llm.queries import QUERIES


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            row[j + 1], last = (last + 1 if x == y else max(row[j], row[j + 1])), row[j + 1]
    return row[-1]


def test_common_length():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(1, 6, rng.integers(1, 90)), rng.integers(0, 8, rng.integers(0, 200))
        masks = {}
        for i, x in enumerate(a.tolist()):
            masks[x] = masks.get(x, 0) | 1 << i
        assert D.common_length(masks, len(a), b) == lcs(a.tolist(), b.tolist())


def test_randomised_svd(spark):
    rng = np.random.default_rng(2)
    dense = np.where(rng.random((60, 40)) < 0.2, rng.random((60, 40)), 0)
    rows = [(np.flatnonzero(r).tolist(), r[r != 0].tolist()) for r in dense]
    got = D.randomised_svd(spark.createDataFrame(rows, "cols array<long>, vals array<double>").repartition(3), 40, 12)
    want = np.linalg.svd(dense)[2][:12].T
    kept = [np.linalg.norm(dense @ x) for x in (got, want)]
    assert kept[0] >= 0.98 * kept[1] and np.allclose(got.T @ got, np.eye(12), atol=1e-8)


def held(words, item):
    """Whether the item's words stand in the text as a run."""
    return any(words[i : i + len(item)] == item for i in range(len(words) - len(item) + 1))


def test_query_finds_every_copy_and_nothing_unlike(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: D.words_of((r.text or "").encode()) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    items = {r.item_id: D.words_of(r.text.encode()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    want = {(d, i) for d, w in docs.items() for i, item in items.items() if held(w, item)}
    rows = QUERIES["op4_latent_decontamination"](spark, folder).collect()
    got = {(r.doc_id, r.item_id): r for r in rows}
    assert want and want <= set(got) and len(rows) == len(got)
    for (d, i), r in got.items():
        assert r.lcs >= 0.6 and lcs(items[i], docs[d]) >= r.lcs * len(items[i]) - 1e-9


ITEM = "the quick brown fox jumps over a lazy dog while seven silver swans swim slowly past the old mill and nobody notices them"


def test_paraphrases_need_the_answer(spark, table):
    filler = " ".join(f"plain{i}" for i in range(40))
    words = ITEM.split()
    changed = [w if i % 3 or i > len(words) - 7 else f"other{i}" for i, w in enumerate(words)]
    unanswered = changed[:-3] + ["someone", "sees", "it"]
    texts = {
        1: f"{filler} {ITEM} {filler}",
        2: f"{filler} {' '.join(changed)} {filler}",
        3: f"{filler} {' '.join(unanswered)} {filler}",
        4: filler,
        5: None,
        6: "",
        7: f"{filler} " * 2000 + ITEM.upper(),
    }
    df = spark.createDataFrame([(i, t, "x", 1, 0.5) for i, t in texts.items()] * 2, "doc_id long, text string, answer string, item_id long, lcs double")
    bench = spark.createDataFrame([(9, ITEM), (10, None), (11, ""), (12, "unrelated words of another item entirely")], "item_id long, text string")
    got = QUERIES["op4_latent_decontamination"](spark, table(documents=df, benchmark=bench)).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted([(1, 9), (2, 9), (7, 9)] * 2)
    kept = D.decontaminate(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 6}


def test_answers_and_blocks_of_items(spark):
    bench = spark.createDataFrame([(i, f"question {i} about topic{i} word{i} with more text", f"answer {i}") for i in range(7)], "item_id long, text string, reply string")
    docs = spark.createDataFrame([(i, f"note question {i} about topic{i} word{i} with more text answer {i}") for i in range(7)], "doc_id long, text string")
    got = D.find(docs, bench, answer_col="reply", item_block=3).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.lcs == 1.0} == {(i, i) for i in range(7)}


def test_empty_tables(spark, documents):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.find(documents, bench).collect() == [] and D.decontaminate(documents.limit(3), bench).count() == 3
    assert D.find(documents.limit(0), spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect() == []


def test_a_find_removes_its_own_row_only(spark):
    bench = spark.createDataFrame([(9, ITEM)], "item_id long, text string")
    rows = [(None, f"before it {ITEM}"), (None, "a clean text without an id"), (4, ITEM), (4, "a clean text under the same id")]
    kept = D.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted(r.text for r in kept) == ["a clean text under the same id", "a clean text without an id"]


def test_recall_does_not_fall_with_the_number_of_documents(spark, monkeypatch):
    """Short items and paraphrases among words the benchmark lacks, at shares of documents that
    stay while their number grows."""
    rng = np.random.default_rng(8)
    common = [f"c{i}" for i in range(40)]
    texts = [" ".join(rng.choice(common + [f"r{k}a{i}" for i in range(6)], 10 + 14 * (k % 2))) for k in range(40)]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    items = D.items_of([(k, t, None) for k, t in enumerate(texts)])
    planted = []
    for k, item in enumerate(items):
        words = [w.decode() for w in item.words]
        if k % 2:  # a paraphrase: 38 % of the words replaced, the last five kept
            for at in rng.choice(len(words) - 5, int(0.38 * len(words)), replace=False):
                words[at] = f"z{k}n{at}"
        lead = rng.integers(5, 25)
        planted.append(" ".join([f"y{k}n{i}" for i in range(lead)] + words + [f"q{k}n{i}" for i in range(40)]).encode())
    shares = np.where([w.startswith(b"c") for w in sorted({w for i in items for w in i.words})], 0.4, 0.002)
    for n in (10**4, 15 * 10**6, 10**9):
        monkeypatch.setattr(D, "document_frequencies", lambda docs, vocabulary, n=n: (shares * n, n))
        index = D.build(None, bench, items, 384)
        got = {(doc, item) for doc, item, *_ in D.search(index, planted, cosine=0.5, copied=0.8, paraphrased=0.6)}
        assert got >= {(k, k) for k in range(len(items))}


def test_paraphrases_with_an_answer_apart(spark):
    changed = " ".join(w if i % 3 else f"other{i}" for i, w in enumerate(ITEM.split()))
    bench = spark.createDataFrame([(9, ITEM, "Forty two")], "item_id long, text string, reply string")
    docs = spark.createDataFrame([(1, f"{changed} forty two"), (2, f"{changed} forty one")], "doc_id long, text string")
    got = D.find(docs, bench, answer_col="reply").collect()
    assert [(r.doc_id, r.answer_found) for r in got] == [(1, True)] and got[0].lcs < 0.8


def test_rare_words_lose_no_find(monkeypatch):
    """Random texts of few words with pieces of items: the same finds as with every window compared."""
    rng = np.random.default_rng(5)
    words = [b"w%d" % i for i in range(60)]
    items = [D.Item(k, [words[j] for j in rng.integers(0, 60, n)], []) for k, n in enumerate([1, 3, 15, 16, 17, 40, 59, 100])]
    for item in items:
        item.answer = item.words[-5:]
    vocabulary = {w: i for i, w in enumerate(words, 1)}
    frequency = rng.integers(0, 50, 60)
    latent = np.concatenate([np.zeros((1, 8)), rng.normal(size=(60, 8))]).astype(np.float32)
    vectors, owner = [], []
    for k, item in enumerate(items):
        for part in D.passages_of(item.words):
            vectors.append(latent[[vocabulary[w] for w in part]].sum(0))
            owner.append(k)
    vectors = np.array([v / np.linalg.norm(v) for v in vectors], np.float32)
    texts = [b"", b"unknown"]
    for _ in range(60):
        text = [words[j] if j < 60 else b"other" for j in rng.integers(0, 75, rng.integers(0, 120))]
        item = items[rng.integers(len(items))].words
        text[5:5] = [w for w in item if rng.random() < 0.8]
        texts.append(b" ".join(text))
    index = D.Index(vocabulary, latent, vectors, np.array(owner), items, D.rare_words(items, vocabulary, frequency, 0.6))
    got = D.search(index, texts, 0.3, 0.8, 0.6)
    monkeypatch.setattr(D.Rare, "near", lambda self, flat, block, total: np.ones((total, len(items)), bool))
    every = D.search(index, texts, 0.3, 0.8, 0.6)
    strip = lambda rows: [(d, i, share, there, round(c, 4)) for d, i, c, share, there in rows]
    assert strip(got) == strip(every) and len(got) > 20
