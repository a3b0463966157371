import zlib

import numpy as np

from bazarlytics.llm import toxicity
from bazarlytics.llm.queries import QUERIES


def sample(rng, n=600):
    """Insults make texts toxic, and insulted texts mention one group more often."""
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        words = [f"word{rng.integers(40)}" for _ in range(12)]
        if toxic:
            words.insert(3, ["rotten", "vile", "wretch"][rng.integers(3)] if rng.random() < 0.6 else "fool")
        if rng.random() < (0.8 if toxic else 0.05):
            words.insert(6, "women")
        if rng.random() < 0.3:
            words.insert(8, "men")
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_swaps_lower_the_weight_of_a_group(spark):
    rows = sample(np.random.default_rng(4))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")

    def gap(strength):
        score = toxicity.fit(docs, labels, counterfactual=strength).scorer()
        assert score("some vile word1") > 0.5 > score("some word1 word2")
        logit = lambda p: np.log(p / (1 - p))
        return abs(logit(score("the women word1")) - logit(score("the men word1")))

    assert gap(10.0) < 0.25 * gap(0.0)


def test_swap_stays_in_the_line():
    assert toxicity.swap("women", 0) == "men" and toxicity.swap("word", 3) == "word"
    assert {toxicity.swap("women", t) for t in range(9)} == set(toxicity.IDENTITY_TERMS[0]) - {"women"}


def test_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    rows = QUERIES["op3_counterfactual_toxicity"](spark, folder).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    toxic, clean = [p for y, p in held if y == 1], [p for y, p in held if y == 0]
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.005


def test_odd_rows(spark, table):
    rows = [(1, None), (2, ""), (3, "vile " * 40_000), (3, "vile " * 40_000), (None, "x")] + [(10 + i, f"text {'vile' if i % 2 else 'fine'} {i}") for i in range(60)]
    docs = spark.createDataFrame([(i, t, 0.1, "c") for i, t in rows], "doc_id long, text string, toxicity double, c0 string")
    labels = [(10 + i, i % 2) for i in range(60)] + [(11, 1), (2, None), (None, 1)]
    marked = spark.createDataFrame([(i, y, 0) for i, y in labels], "doc_id long, toxic int, quality int")
    got = QUERIES["op3_counterfactual_toxicity"](spark, table(documents=docs, labels=marked)).collect()
    by = {r.doc_id: r.predicted for r in got}
    assert len(got) == len(rows) and all(r.held_out is not None for r in got) and by[1] == by[2] == by[None] == 0 and by[3] == by[11] == 1 and by[12] == 0
    none = QUERIES["op3_counterfactual_toxicity"](spark, table(documents=docs, labels=marked.limit(0))).collect()
    assert {r.predicted for r in none} == {0} and all(0 <= r.score <= 1 for r in none)
    assert QUERIES["op3_counterfactual_toxicity"](spark, table(documents=docs.limit(0), labels=marked)).collect() == []


def test_a_repeated_id_does_not_widen_the_fit(spark):
    rows = [(i % 3, f"{'vile' if i % 3 else 'fine'} text {i % 7}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "doc_id long, toxic int")
    score = toxicity.fit(docs, labels, fit_rows=60).scorer()
    assert score("vile text") > 0.5 > score("fine text")
