import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from bazarlytics.llm import secrets, toxicity
from bazarlytics.llm.tokens import default_path
from tests.llm import brute
from tests.llm.test_decontaminate import D, held
from tests.llm.test_packing import check_sequences

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What goes into and comes out of every stage."""
    out = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, out[-1], FOLDER).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay(steps):
    assert all(df.columns == steps[0].columns for df in steps[:-1])


def test_toxic_documents_go_and_clean_ones_stay(spark, steps):
    kept, before = texts(steps[1]), texts(steps[0])
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    toxic = [d for d in before if labels.get(d) == 1]
    clean = [d for d in before if labels.get(d) == 0]
    assert sum(d not in kept for d in toxic) >= 0.85 * len(toxic) and sum(d in kept for d in clean) >= 0.99 * len(clean)
    model = toxicity.fit(steps[0], spark.read.parquet(f"{FOLDER}/labels.parquet")).scorer()
    assert set(kept) == {d for d, t in before.items() if model(t or "") < 0.7}


def test_one_document_of_each_group_stays(steps):
    before = sorted(texts(steps[1]).items())
    roots = brute.near_components([brute.simhash(t) for _, t in before], 4)
    assert set(texts(steps[2])) == {before[r][0] for r in roots}


def test_documents_with_benchmark_items_go(spark, steps):
    items = [D.words_of(r.text.encode()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    before, kept = texts(steps[2]), texts(steps[3])
    has = {d for d, t in before.items() if any(held(D.words_of((t or "").encode()), i) for i in items)}
    assert has and has.isdisjoint(kept) and len(before) - len(kept) <= len(has) + 2


def test_secrets_are_masked(steps):
    from tests.llm.test_secrets import base

    before, after = steps[3].collect(), {r.doc_id: r for r in steps[4].collect()}
    assert len(before) == len(after)
    table = secrets.fit(steps[3])
    spans = {r.doc_id: r.spans for r in secrets.scan(steps[3], table).collect()}
    for r in before:
        now, text = after[r.doc_id], r.text
        for s in sorted(spans[r.doc_id], key=lambda s: -s.start):
            text = text[: s.start] + "[SECRET]" + text[s.end :]
        if len(spans[r.doc_id]) <= 1:
            assert now.text == text
        assert not base(now.text or "") and (now.text == r.text) == (not spans[r.doc_id])


def test_packed_ids_are_the_texts(steps):
    plain = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    rows, want = steps[5].collect(), texts(steps[4])
    check_sequences((r.sequence_id, r.offset, r.length) for r in rows)
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == {d: [*plain.encode(t or "", add_special_tokens=False).ids, 0] for d, t in want.items()}


def test_odd_tables(spark, table):
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxicity double, _hit int"
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, None)], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, "a few words here now"), (3, "a few words here now"), (None, "no id for this one")]
    df = spark.createDataFrame([(i, t, None, None, None, 0.5, 1) for i, t in rows], schema)
    packed = corpus_pipeline.run(spark, table(documents=df, labels=labels, benchmark=bench)).collect()
    assert {r.doc_id for r in packed} == {1, 3, None}
    assert corpus_pipeline.run(spark, table(documents=df.limit(0), labels=labels, benchmark=bench)).collect() == []
