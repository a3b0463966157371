"""Checksums of parts, the keys that differ, and the order fact rebuilt by months."""

import collections
import random

import pytest

from bazarlytics.operators.checksums import differences, differing_parts, part_checksums
from bazarlytics.plans import incremental
from tests.test_models import CUSTOMERS, item, order, pay, review, shop  # noqa: F401

SCHEMA = "part string, id int, a string, b string"


def brute(left, right):
    one, two = collections.Counter(left), collections.Counter(right)
    ours, theirs = one - two, two - one
    out = {}
    for side, rows in enumerate((ours, theirs)):
        for (part, key, *_), n in rows.items():
            out.setdefault((part, key), [0, 0])[side] += n
    return {
        (*k, l, r, "only_left" if not r else "only_right" if not l else "changed") for k, (l, r) in out.items()
    }


def test_differences_are_those_of_the_multisets(frame):
    rng = random.Random(3)
    rows = [(rng.choice(["x", "y", "z", None]), rng.choice([1, 2, 3, 4, 5, None]), *rng.choices(["p", "q", None], k=2)) for _ in range(200)]
    other = [r if r[0] != "y" or rng.random() < 0.9 else (*r[:2], r[3], r[2]) for r in rows][5:] + [("new", 1, None, "p")]
    left, right = frame(rows, SCHEMA), frame(other, SCHEMA).select("b", "a", "id", "part")
    got = differences(left, right, ["id"], "part").select("part", "id", "left_rows", "right_rows", "change").collect()
    assert {tuple(r) for r in got} == brute(rows, other) and len(got) == len(brute(rows, other))
    assert "new" in differing_parts(left, right.select(left.columns), "part")


def test_equal_and_empty_tables(frame):
    rows = [("x", 1, None, "p"), ("x", 1, None, "p"), (None, None, None, None)]
    for a in (rows, []):
        one, two = frame(a, SCHEMA).repartition(3), frame(a[::-1], SCHEMA)
        assert differing_parts(one, two, "part") == []
        assert differences(one, two, ["id"], "part").count() == 0


def test_checksum_tells_where_a_null_stands_and_how_often_a_row_comes(frame):
    sums = [
        part_checksums(frame(rows, SCHEMA), "part").first()
        for rows in ([("x", 1, None, "p")], [("x", 1, "p", None)], [("x", 1, None, "p")] * 2)
    ]
    assert len({(r["rows"], r.sum_1) for r in sums}) == 3 and len({r.sum_2 for r in sums}) == 3


@pytest.fixture
def fact(spark, frame, shop, tmp_path):  # noqa: F811
    """A function from raw rows to (months rewritten, stored fact, full build)."""
    path, shops = str(tmp_path / "fact"), []

    def run(**rows):
        from bazarlytics.plans.warehouse import Warehouse
        from bazarlytics.sources.schemas import RAW

        raw = {t: (lambda t=t: frame(rows.get(t, []), RAW[t])) for t in RAW}
        shops.append(Warehouse(spark, raw, str(tmp_path / f"shop{len(shops)}")))
        w = shops[-1]
        inputs = [w[f"stg_{t}"] for t in ("orders", "customers", "reviews", "payments", "order_items")]
        months = incremental.refresh_orders(path, *inputs)
        full = w.plan("fct_orders")
        stored = incremental.read_orders(spark, path, full)
        assert sorted(map(str, stored.collect())) == sorted(map(str, full.collect()))
        return [m.month if m else None for m in months]

    run.path = path
    return run


def test_refresh_rewrites_the_changed_months_only(fact, spark):
    rows = dict(
        orders=[order(1), order(2, days=31), order(3, "c2", days=61)], customers=CUSTOMERS,
        payments=[pay(1), pay(2), pay(3)], reviews=[review(1), review(1, 2), review(2)],
        order_items=[item(1), item(2), item(3)],
    )
    assert fact(**rows) == [3, 4, 5]
    files = {f for f in spark.read.parquet(fact.path).inputFiles() if "2018-04" not in f}
    assert fact(**rows) == []
    assert fact(**{**rows, "payments": [pay(1), pay(2, value="1.00"), pay(3)]}) == [4]
    assert files == {f for f in spark.read.parquet(fact.path).inputFiles() if "2018-04" not in f}
    assert fact(**rows) == [4]
    # a customer who moves, a review that goes, a detail whose order is not known
    moved = [("c1", "u1", "01037", "sao paulo", "SP"), ("c2", "u2", "20000", "niteroi", "RJ")]
    assert fact(**{**rows, "customers": moved}) == [5]
    assert fact(**{**rows, "customers": moved, "reviews": [review(1), review(2)]}) == [3]
    assert fact(**{**rows, "customers": moved, "reviews": [review(1), review(2), review(9)]}) == []


def test_refresh_of_orders_that_move_leave_and_come_back(fact):
    two = dict(orders=[order(1), order(2, days=31)], customers=CUSTOMERS, payments=[pay(1), pay(2)])
    assert fact(**two) == [3, 4]
    assert fact(**{**two, "orders": [order(1), order(2)]}) == [3, 4]  # April is empty now
    assert fact(**{**two, "orders": []}) == [3]
    assert fact(**two) == [3, 4]


def test_refresh_without_a_purchase_time(fact):
    timeless = (*order(2)[:3], None, *order(2)[4:])
    assert fact(orders=[order(1), timeless], customers=CUSTOMERS, payments=[pay(2)]) == [None, 3]
    assert fact(orders=[order(1), timeless], customers=CUSTOMERS, payments=[pay(2, value="3.00")]) == [None]
    assert fact(orders=[order(1)], customers=CUSTOMERS) == [None]
