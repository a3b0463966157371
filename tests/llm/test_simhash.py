import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bazarlytics.llm import simhash
from bazarlytics.llm.queries import QUERIES
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.none(), st.text(max_size=60), st.lists(st.sampled_from("a B cÄ \t x\x1cy").map(str), max_size=40).map("".join)))
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == brute.simhash(text)


@pytest.mark.parametrize("layout", list(simhash.LAYOUTS))
@pytest.mark.parametrize("threshold", [0, 1, 3, 4, 6])
def test_partners_share_an_anchor(layout, threshold):
    rng = np.random.default_rng(threshold)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    y = x.copy()
    for row in range(len(y)):
        for bit in rng.choice(64, threshold, replace=False):
            y[row] ^= np.uint64(1) << np.uint64(bit)
    met = np.zeros(len(x), bool)
    for cut in simhash.segments(threshold, layout):
        home = cut.anchor(cut.bits(x))
        reach = cut.anchor(cut.bits(y)[:, None] ^ cut.errors[None, :])
        met |= (reach == home[:, None]).any(1)
    assert met.all()


def test_codes_are_perfect():
    for code, radius in ((simhash.GOLAY, 3), (simhash.HAMMING_15, 1), (simhash.HAMMING_7, 1)):
        _, leader = simhash.Code(*code).tables()
        assert np.bitwise_count(leader.astype(np.uint64)).max() == radius


@pytest.mark.parametrize("layout", list(simhash.LAYOUTS))
@pytest.mark.parametrize("block", [7, 1024])
def test_groups_against_all_pairs(spark, monkeypatch, layout, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SHORT", 8)
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 60)
    prints = [0, 0, 3]
    for v in base:
        for _ in range(rng.integers(1, 12)):
            flips = sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False))
            prints.append(int(v) ^ flips)
    df = spark.createDataFrame([(i * 10, p) for i, p in enumerate(prints)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.near_groups(df, layout=layout).collect()}
    want = brute.near_components([p & ((1 << 64) - 1) for p in prints], 4)
    assert got == {i * 10: w * 10 for i, w in enumerate(want)}


def test_query_against_brute_force(spark, folder, documents):
    rows = documents.select("doc_id", "text").orderBy("doc_id").collect()
    prints = [brute.simhash(r.text) for r in rows]
    want = brute.near_components(prints, 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash_near_dedup"](spark, folder).collect()}
    assert got == {r.doc_id: (f"{p:016x}", rows[w].doc_id) for r, p, w in zip(rows, prints, want)}


def test_odd_rows(spark, table):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(5, None), (3, ""), (9, " \t\n"), (4, "one two"), (2, "One  TWO"), (7, long), (8, long), (8, long), (None, "null id here now")]
    df = spark.createDataFrame([(i, t, "fp", "id", 1) for i, t in rows], "doc_id long, text string, fp string, id string, component_id long")
    got = [tuple(r) for r in QUERIES["op1_simhash_near_dedup"](spark, table(documents=df)).collect()]
    by = {}
    for i, fp, c in got:
        by.setdefault(i, []).append((fp, c))
    assert {i: [c for _, c in v] for i, v in by.items() if i is not None} == {5: [3], 3: [3], 9: [3], 4: [2], 2: [2], 7: [7], 8: [7, 7]}
    assert by[3][0][0] == "0" * 16 and len(by[None]) == 1
    assert QUERIES["op1_simhash_near_dedup"](spark, table(documents=df.limit(0))).collect() == []


def test_deduplicate_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e", "x"), (2, "a b c d e", "y"), (3, "f g h i j", "z")], "doc_id long, text string, fp string")
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_classes_without_id_bridge_only_what_they_touch(spark):
    """Two null-id classes near different documents, a chain through a null-id class, large ids."""
    a, b, c = 0x0F0F0F0F0F0F0F0F, 0x7EDCBA9876543210, 0x123456789ABCDEF0
    big = 2**53
    rows = [(big + 1, a), (None, a ^ 0b11), (big + 3, b), (None, b ^ 0b11), (big + 5, c), (None, c ^ 0xF), (big + 7, c ^ 0xFF)]
    df = spark.createDataFrame(rows, "doc_id long, fp long").coalesce(1)
    got = {r.fp: r.component_id for r in simhash.near_groups(df).collect()}
    first = {a: big + 1, a ^ 0b11: big + 1, b: big + 3, b ^ 0b11: big + 3}
    assert got == first | {fp: big + 5 for fp in (c, c ^ 0xF, c ^ 0xFF)}


def test_deduplicate_tells_rows_apart_by_text(spark):
    texts = ["a b c d e", "f g h i j", "k l m n o", "p q r s t", "u v w x y"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (None, texts[4]), (9, texts[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.text, r.doc_id) for r in simhash.deduplicate(df).collect())
    assert got == list(zip(texts, [None, None, 7, 7, 9]))
