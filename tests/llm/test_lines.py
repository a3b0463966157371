import hashlib
from collections import defaultdict

import pytest

from bazarlytics.llm import lines
from bazarlytics.llm.queries import QUERIES

CASE = {c: c + 32 for c in range(65, 91)}
SHARED = "This Line stands in a good many documents, ÉVERY time."


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(CASE)


def brute(rows, least_chars=40, least_docs=5):
    """(id, lines, dropped, text) of every row."""
    docs = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                docs[key(line)].add(-1 if i is None else i)
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if len(docs[key(x)]) < least_docs or max(docs[key(x)]) == (-1 if i is None else i)]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def cleaned(df, **options):
    return [(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in lines.drop_repeated_lines(df, **options).collect()]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_tables(spark, name):
    docs = spark.read.parquet(f"/root/testdata/{name}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(rows)}
    found = QUERIES["op12_line_dedup"](spark, f"/root/testdata/{name}").collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in found} == want
    assert len(found) == len(rows) and any(d for _, d, _ in want.values())


def test_odd_rows(spark):
    rows = [(i, f"own {i}\n  {SHARED}\t\nend\n{SHARED.replace('T', 't')}\x0b\n") for i in range(6)]
    rows += [(2, rows[2][1]), (2, f"other text\r\n{SHARED}"), (None, f"no id\n{SHARED}"), (None, SHARED), (9, None), (9, "")]
    rows += [(7, "short\n" * 50), (8, SHARED.replace("É", "é"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert order(cleaned(df)) == order(brute(rows))
    assert order(cleaned(df, least_docs=1, least_chars=1)) == order(brute(rows, 1, 1))
    assert cleaned(df.limit(0)) == []
    null = [r.text for r in lines.drop_repeated_lines(df).where("doc_id = 9").collect()]
    assert sorted(null, key=str) == ["", None]


def test_largest_document_keeps_all_its_lines(spark):
    rows = [(i, f"{SHARED}\nx\n{SHARED}") for i in range(5)]
    found = {i: t for i, _, _, t in cleaned(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert found == {**{i: "x" for i in range(4)}, 4: rows[4][1]}


def test_four_documents_are_not_enough(spark):
    rows = [(i, SHARED) for i in (1, 2, 3, 4, 4, 4)]
    assert all(d == 0 for _, _, d, _ in cleaned(spark.createDataFrame(rows, "doc_id long, text string")))


def test_clashing_columns_stay(spark):
    rows = [(f"{SHARED}\ny", 1, "m", i, 5, 6, 7) for i in range(5)]
    df = spark.createDataFrame(rows, "text string, n_lines int, `meta.src` string, doc_id long, N_DROPPED int, body int, drop int")
    out = lines.drop_repeated_lines(df)
    assert out.columns == [*df.columns, "n_lines_", "n_dropped_"]
    assert {(r.doc_id, r.text, r.n_lines_, r.n_dropped_, r["meta.src"], r.body) for r in out.collect()} == {
        (i, "y" if i < 4 else f"{SHARED}\ny", 2, int(i < 4), "m", 6) for i in range(5)
    }


def test_hot_line_and_long_text(spark):
    long = "\n".join(f"{SHARED} {i % 700}" for i in range(20_000))
    rows = [(i, f"{SHARED}\nline {i}") for i in range(400)] + [(1000 + i, long) for i in range(6)]
    found = {i: (n, d) for i, n, d, _ in cleaned(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))}
    assert all(found[i] == (2, 1) for i in range(399)) and found[399] == (2, 0)
    assert all(found[1000 + i] == (20_000, 20_000 if i < 5 else 0) for i in range(6))


def test_plan_is_native(spark, folder):
    plan = QUERIES["op12_line_dedup"](spark, folder)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
