import random
import re

import pytest

from bazarlytics.llm import licenses
from bazarlytics.llm.queries import QUERIES


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(w):
    return [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(text, templates, share=0.8):
    """Every window of every template's class, compared outright."""
    found, own = {}, shingles(words(text))
    for name, template in templates:
        target = set(shingles(words(template)))
        span = 1 << (len(target) - 1).bit_length()
        step = max(1, span // 4)
        for start in range(0, len(own), step):
            held = len(target & set(own[start : start + span + step - 1])) / len(target)
            if held >= share:
                best = found.get(name, (0, 0))
                found[name] = max(best, (held, -start))
    return {(name, held, -start) for name, (held, start) in found.items()}


def test_query_against_all_windows(spark, folder, documents):
    want = {(r.doc_id, *m) for r in documents.collect() for m in brute(r.text, licenses.TEMPLATES)}
    got = {tuple(r) for r in QUERIES["op6_license_scan"](spark, folder).collect()}
    assert got == want and got


def test_changed_and_odd_texts(spark, table):
    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, "four words are few"), (None, licenses.TEMPLATES[0][1])]
    for i, (_, text) in enumerate(licenses.TEMPLATES, 10):
        w = text.split()
        if len(w) > 30:  # a word changed near an end keeps most shingles
            w[1] = "changed"
        filler = " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit"]) + str(rng.randrange(99)) for _ in range(rng.randrange(70)))
        rows += [(i, f"{filler} {' '.join(w)} {filler}")] * 2
    rows.append((99, "filler text " * 60_000 + licenses.TEMPLATES[1][1]))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, license string, words int")
    want = {(i, *m) for i, t in rows for m in brute(t, licenses.TEMPLATES)}
    got = QUERIES["op6_license_scan"](spark, table(documents=df)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert {r.doc_id for r in got} == {None, 99, *range(10, 10 + len(licenses.TEMPLATES))}
    assert QUERIES["op6_license_scan"](spark, table(documents=df.limit(0))).collect() == []


def test_bands_and_bounds(spark, documents):
    assert (1 - 0.8 / 2 / 1.35) ** licenses.bands_for(0.8) <= 1e-6
    few = spark.createDataFrame([("short", "too few"), ("none", None)], "license string, text string")
    assert licenses.match(documents, few).collect() == []
    many = spark.createDataFrame([("x", f"one two three four {i}") for i in range(4)], "license string, text string")
    with pytest.raises(ValueError):
        licenses.match(documents, many, most_templates=3)
