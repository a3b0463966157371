import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bazarlytics.llm import packing
from bazarlytics.llm.queries import QUERIES
from bazarlytics.llm.tokens import default_path
from tests.llm.test_wavelet import NAMES, expected

CAPACITY = 2048


def check_sequences(rows, capacity=CAPACITY):
    """Rows (sequence, offset, length): gapless from 0 and within the capacity."""
    by = defaultdict(list)
    for s, offset, length in rows:
        by[s].append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_sum_of_squares(sizes):
    bins, offsets, made = packing.sum_of_squares(np.array(sizes, np.int64), 20)
    assert check_sequences(zip(bins.tolist(), offsets.tolist(), sizes), 20) == made
    fills = np.bincount(bins, sizes, made) if sizes else []
    assert all(a + b > 20 for i, a in enumerate(fills) for b in fills[i + 1 :])


def test_query_against_the_library(spark, folder, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = set()
    for key, ids in expected(rows, NAMES[1], 0):
        cuts = [0, *range(len(ids) % CAPACITY or CAPACITY, len(ids) + 1, CAPACITY)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.add((key, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got = QUERIES["op9_sum_of_squares_packing"](spark, folder).collect()
    assert len(got) == len(want) and {tuple(r)[:5] for r in got} == want
    made = check_sequences((r.sequence_id, r.offset, r.length) for r in got)
    assert made <= -(-sum(r.length for r in got) // CAPACITY) + 1


def test_many_groups_stay_close_to_one(spark):
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, CAPACITY + 1, 6000).tolist()
    df = spark.createDataFrame([(i % 5, n, "x") for i, n in enumerate(lengths)], "doc_id int, length long, fill string")
    got = packing.place(df, group=2000)
    assert got.columns == ["doc_id", "length", "fill", "sequence_id", "offset"]
    rows = got.collect()
    assert sorted(r.length for r in rows) == sorted(lengths)
    made = check_sequences((r.sequence_id, r.offset, r.length) for r in rows)
    assert made <= 1.01 * packing.sum_of_squares(np.array(lengths), CAPACITY)[2]


def test_odd_rows(spark, table):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "z"), (4, "word " * 8999 + "word")]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, length int")
    got = QUERIES["op9_sum_of_squares_packing"](spark, table(documents=df)).collect()
    check_sequences((r.sequence_id, r.offset, r.length) for r in got)
    assert sorted((r.doc_id, r.piece) for r in got if r.doc_id in (1, 2, 3)) == [(1, 0), (2, 0), (3, 0), (3, 0)]
    long = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 4)
    assert [n for *_, n in long][1:] == [CAPACITY] * (len(long) - 1) and sum(n for *_, n in long) == 9001
    assert QUERIES["op9_sum_of_squares_packing"](spark, table(documents=df.limit(0))).collect() == []


def test_sequences_hold_the_ids(spark, documents):
    parts = packing.pieces(documents.limit(40), default_path(NAMES[1]))
    packed = packing.place(parts)
    made = packing.sequences(packed)
    total = parts.agg(F.sum("length")).first()[0]
    assert made.agg(F.sum(F.octet_length("ids"))).first()[0] == 4 * total


def test_place_beside_clashing_names(spark):
    rows = spark.createDataFrame(
        [("a", 7, 9, 9, 5, "x"), (None, 8, 9, 9, None, "y")], "`_packed` string, length long, sequence_id long, offset long, size int, `meta.src` string"
    )
    got = packing.place(rows)
    assert got.columns == ["_packed", "length", "size", "meta.src", "sequence_id", "offset"]
    assert sorted((r.length, r["size"], r["meta.src"]) for r in got.collect()) == [(7, 5, "x"), (8, None, "y")]
    assert {(r.sequence_id, r.offset) for r in got.collect()} in ({(0, 0), (0, 7)}, {(0, 0), (0, 8)})
    numbers = packing.place(rows.select("length", "sequence_id", "offset", "size")).collect()
    assert check_sequences([(r.sequence_id, r.offset, r.length) for r in numbers]) == 1
