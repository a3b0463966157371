import numpy as np
import pytest

from bazarlytics.llm import embeddings
from bazarlytics.llm.queries import QUERIES
from tests.llm import brute


def expected(rows, least=0.9):
    """From (id, vector or None); ids are unique."""
    good = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([rows[i][1] for i in good], float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    a, b = np.nonzero(x @ x.T >= least)
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    rank = {i: r for r, i in enumerate(order)}
    links = [(rank[good[p]], rank[good[q]]) for p, q in zip(a.tolist(), b.tolist()) if p != q]
    comp = brute.components(len(rows), links)
    n = np.bincount([p for p, _ in links], minlength=len(rows))
    out = set()
    for i, (key, _) in enumerate(rows):
        root = rows[order[comp[rank[i]]]][0]
        out.add((key, int(n[rank[i]]), root, key == root))
    return out


def test_query_against_all_pairs(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = QUERIES["op8_metric_near_dedup"](spark, folder).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == expected(rows)


@pytest.mark.parametrize("per_cell", [16, 300])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_clusters_and_copies(spark, per_cell, kind):
    rng = np.random.default_rng(per_cell)
    rows = []
    for center in rng.normal(size=(30, 6)):
        for _ in range(rng.integers(1, 12)):
            v = (center + rng.normal(size=6) * rng.choice([0.01, 0.2, 0.5])).astype(np.float32)
            rows += [v.tolist()] * int(rng.choice([1, 1, 3]))
    rows += [(np.array(rows[0]) * 4).tolist()] * 90
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(rows)) * 3, rows)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = embeddings.near_vectors(df, per_cell=per_cell).collect()
    assert {tuple(r) for r in got} == expected(rows)


def test_odd_vectors(spark, table):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (9, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0])]
    schema = "vec_id long, embedding array<float>, label int, id long, copies long, data binary"
    df = spark.createDataFrame([(i, v, 0, 5, 5, b"x") for i, v in [*rows, (None, [1.0, 0.0])]], schema)
    got = {tuple(r) for r in QUERIES["op8_metric_near_dedup"](spark, table(embeddings=df)).collect()}
    alone = {(i, 0, i, True) for i, _ in rows if i not in (7, 9)}
    assert got == alone | {(7, 1, 7, True), (9, 1, 7, False), (None, 0, None, False)}
    assert QUERIES["op8_metric_near_dedup"](spark, table(embeddings=df.limit(0))).collect() == []
