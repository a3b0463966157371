"""Months as bits against plain sets of months."""

import collections
import datetime as dt
import random

from bazarlytics.analyses import activity


def orders(frame, rows):
    return frame(
        [(c, None if n is None else dt.date(n // 12, n % 12 + 1, 1), d) for c, n, d in rows],
        "customer_id string, order_month date, is_delivered boolean",
    )


def sample(seed=1):
    """Months over the border of a row: 12 * 1995 is the first month of row 399."""
    rng, low = random.Random(seed), 12 * 1995 - 50
    return [(rng.choice(["a", "b", "c", "d", None]), low + rng.randrange(130), rng.random() < 0.7) for _ in range(150)] + [
        ("e", 12 * 1995 - 1, True), ("e", 12 * 1995, True), ("f", None, True), ("g", low, None),
    ]


def months_of(rows):
    out = collections.defaultdict(set)
    for c, n, d in rows:
        if c is not None and n is not None and d:
            out[c].add(n)
    return out


def number(day):
    return 12 * day.year + day.month - 1


def test_answers_equal_sets_of_months(frame):
    rows = sample()
    table, people = activity.customer_activity(orders(frame, rows)), months_of(rows)
    cohorts = collections.Counter((min(s), n - min(s)) for s in people.values() for n in s)
    got = {(number(r.cohort_month), r.months_since_first): r.active_customers for r in activity.cohort_activity(table).collect()}
    assert got == cohorts
    spread = {r.active_months: r.customers for r in activity.active_months(table).collect()}
    assert spread == collections.Counter(map(len, people.values()))
    kept = {number(r.month): (r.customers, r.came_back) for r in activity.kept_between(table).collect()}
    everyone = sorted(set().union(*people.values()))
    assert kept == {n: (sum(n in s for s in people.values()), sum({n, n + 1} <= s for s in people.values())) for n in everyone}
    churn = {number(r.month): (r.prev_active_customers, r.active_customers) for r in activity.monthly_churn(table).collect()}
    assert churn == {n: (kept[m][0], kept[n][0]) for m, n in zip(everyone, everyone[1:])}


def test_periods_merge(frame):
    rows = sample(2)
    parts = [activity.customer_activity(orders(frame, part)) for part in (rows[:80], rows[60:])]
    whole = activity.customer_activity(orders(frame, rows))
    assert sorted(activity.merge(*parts).collect()) == sorted(whole.collect())


def test_no_orders(frame):
    table = activity.customer_activity(orders(frame, []))
    for answer in (activity.cohort_activity, activity.monthly_churn, activity.active_months, activity.kept_between):
        assert answer(table).count() == 0
