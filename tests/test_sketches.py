"""Sketches of days against exact answers."""

import bisect
import datetime as dt
import random
import statistics

from bazarlytics.analyses import sketches

SCHEMA = "order_date date, customer_id string, total_order_value double"


def sample(n=40_000, seed=3):
    """Four months; a third of all rows are one customer's, and one value is very common."""
    rng, first = random.Random(seed), dt.date(2020, 1, 1)
    return [
        (
            first + dt.timedelta(rng.randrange(120)),
            "hot" if rng.random() < 1 / 3 else f"c{rng.randrange(9000)}",
            10.0 if rng.random() < 0.2 else round(rng.lognormvariate(3, 1), 2),
        )
        for _ in range(n)
    ]


def exact(rows):
    out = {}
    for day, customer, value in rows:
        people, values = out.setdefault(day.replace(day=1), (set(), []))
        people.add(customer)
        values.append(value)
    return out


def test_months_of_merged_days(frame):
    rows = sample()
    got = {r.order_month: r for r in sketches.monthly_estimates(sketches.daily_sketches(frame(rows, SCHEMA))).collect()}
    want = exact(rows)
    assert got.keys() == want.keys()
    for month, (people, values) in want.items():
        assert abs(got[month].customers - len(people)) <= sketches.CUSTOMERS_WITHIN * len(people)
        assert got[month].order_rows == len(values)
        values.sort()
        for share, told in ((0.25, got[month].value_p25), (0.5, got[month].median_value), (0.75, got[month].value_p75)):
            low, high = bisect.bisect_left(values, told) / len(values), bisect.bisect_right(values, told) / len(values)
            assert low - sketches.RANK_WITHIN <= share <= high + sketches.RANK_WITHIN


def test_days_in_two_tables_merge(frame):
    rows = sample(4000)
    halves = [sketches.daily_sketches(frame(part, SCHEMA)) for part in (rows[:2500], rows[2500:])]
    merged = sketches.merge(halves[0].unionByName(halves[1]), "order_date")
    whole = sketches.daily_sketches(frame(rows, SCHEMA))
    few = [{r.order_date: (r.order_rows, r.customers) for r in sketches.estimates(t, "order_date").collect()} for t in (merged, whole)]
    assert few[0].keys() == few[1].keys()
    for day, (n, customers) in few[1].items():
        assert few[0][day][0] == n and abs(few[0][day][1] - customers) <= 1


def test_small_groups_are_exact(frame):
    day = dt.date(2020, 1, 1)
    rows = [(day, c, v) for c, v in (("a", 1.0), ("b", 2.0), ("a", 4.0), (None, None))]
    row = sketches.monthly_estimates(sketches.daily_sketches(frame(rows, SCHEMA))).first()
    assert (row.order_rows, row.customers, row.median_value) == (4, 2, statistics.median_low([1.0, 2.0, 4.0]))


def test_nulls_and_no_rows(frame):
    rows = [(None, "a", 1.0), (dt.date(2020, 1, 1), None, None), (dt.date(2020, 1, 2), "a", None), (dt.date(2020, 2, 2), "a", 3.0)]
    orders = frame(rows, SCHEMA)
    daily = sketches.daily_sketches(orders)
    got = [(r.order_month.month, r.order_rows, r.customers, r.median_value) for r in sketches.monthly_estimates(daily).collect()]
    assert got == [(1, 2, 1, None), (2, 1, 1, 3.0)]
    assert all(r.customers_close and r.median_close for r in sketches.checked_months(daily, orders).collect())
    empty = frame([], SCHEMA)
    assert sketches.checked_months(sketches.daily_sketches(empty), empty).count() == 0


def test_a_wrong_sketch_is_noticed(frame):
    rows = sample(6000)
    half = [(d, c, v * 3) for d, c, v in rows if c < "c5"]
    checked = sketches.checked_months(sketches.daily_sketches(frame(half, SCHEMA)), frame(rows, SCHEMA)).collect()
    assert checked and not any(r.customers_close or r.median_close for r in checked)
