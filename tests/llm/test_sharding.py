import zlib
from collections import Counter, defaultdict

from bazarlytics.llm.queries import QUERIES
from bazarlytics.llm.sharding import even_shards

DOCS = "doc_id long, text string, label int, size int, hub long"


def check(rows, docs, shards=16):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs
    )
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def spread(rows, docs):
    """Shards that each text is in."""
    texts, out = dict(docs), defaultdict(Counter)
    for r in rows:
        out[texts[r.doc_id]][r.shard] += 1
    return out


def test_query(spark, folder, documents):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    rows = QUERIES["op10_balanced_label_propagation"](spark, folder).collect()
    check(rows, docs)
    groups = [c for c in spread(rows, docs).values() if sum(c.values()) > 1]
    assert groups and sum(len(c) == 1 for c in groups) >= 0.9 * len(groups)


def test_groups_stay_together_and_large_ones_are_split(spark):
    docs = [(i, f"pair {i // 2}") for i in range(300)] + [(i, "hot") for i in range(300, 700)] + [(i, f"one {i}") for i in range(700, 1200)]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], DOCS)
    rows = even_shards(df).collect()
    check(rows, docs)
    groups = spread(rows, docs)
    hot = groups.pop("hot")
    assert max(hot.values()) <= 75 and sum(sorted(hot.values())[-8:]) > 200
    pairs = [c for c in groups.values() if sum(c.values()) > 1]
    assert sum(len(c) == 1 for c in pairs) >= 0.9 * len(pairs)


def test_odd_rows(spark, table):
    docs = [(1, None), (2, None), (3, ""), (4, "a"), (4, "a"), (None, "é" * 100_000)]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], DOCS)
    check(QUERIES["op10_balanced_label_propagation"](spark, table(documents=df)).collect(), docs)
    assert QUERIES["op10_balanced_label_propagation"](spark, table(documents=df.limit(0))).collect() == []
