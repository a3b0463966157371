"""Column expressions on literal rows."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from bazarlytics.analyses.revenue import installment_range
from bazarlytics.functions import columns as c
from bazarlytics.functions import values as v


def one(frame, value, kind, column):
    return frame([(value,)], f"x {kind}").select(column("x").alias("y")).first().y


def gap(frame, a, b, column):
    df = frame([(a, b)], "a timestamp_ntz, b timestamp_ntz")
    return df.select(column("a", "b").alias("y")).first().y


@pytest.mark.parametrize("value, label", [(250, "Premium"), (200, "Premium"), (199.99, "High"), (50, "Medium"), (20, "Low"), (19.99, "Budget"), (None, "Budget")])
def test_price_tier(frame, value, label):
    value = None if value is None else float(value)
    assert one(frame, value, "double", lambda x: c.tier(x, v.PRICE_TIER)) == label


@pytest.mark.parametrize("value, label", [(None, "Unknown"), (0, "Unknown"), (1, "Full Payment"), (3, "Short Term (2-3)"), (4, "Medium Term (4-6)"), (12, "Long Term (7-12)"), (13, "Extended Term (12+)")])
def test_installment_category(frame, value, label):
    assert one(frame, value, "int", lambda x: c.tier(x, v.INSTALLMENT_CATEGORY)) == label


@pytest.mark.parametrize("value, label", [(0, "10+x"), (1, "1x (No installment)"), (3, "2-3x"), (10, "7-10x"), (11, "10+x")])
def test_installment_range(frame, value, label):
    assert one(frame, value, "int", installment_range) == label


@pytest.mark.parametrize("value, label", [(None, "No Comment"), (50, "Brief"), (51, "Moderate"), (201, "Detailed")])
def test_comment_detail(frame, value, label):
    assert one(frame, value, "int", lambda x: c.tier(x, v.COMMENT_DETAIL)) == label


def test_day_gap_counts_midnights(frame):
    a, b = dt.datetime(2017, 12, 31, 23, 59), dt.datetime(2018, 1, 1, 0, 1)
    assert gap(frame, a, b, c.day_gap) == 1
    assert gap(frame, b, a, c.day_gap) == -1
    assert gap(frame, a, b, c.month_gap) == 1
    assert gap(frame, a, b, c.days_between) == pytest.approx(2 / 1440)
    assert gap(frame, a, b, c.hours_between) == pytest.approx(2 / 60)


def test_day_of_week_starts_at_sunday(frame):
    assert one(frame, dt.date(2017, 1, 1), "date", c.day_of_week) == 0
    assert one(frame, dt.date(2017, 1, 7), "date", c.day_of_week) == 6


def test_surrogate_key(frame):
    df = frame([("a", None)], "x string, y string").select(c.surrogate_key("x", "y").alias("k"))
    assert df.first().k == hashlib.md5(f"a-{v.SURROGATE_NULL}".encode()).hexdigest()


def test_ratio_needs_a_positive_denominator(frame):
    df = frame([(1, 0), (1, None), (1, 4)], "a int, b int").select(c.percent("a", "b").alias("p"))
    assert [r.p for r in df.collect()] == [None, None, 25.0]


def test_flag_is_never_null(frame):
    df = frame([(None,), (1,)], "x int").select(c.flag(F.col("x") == 1).alias("y"))
    assert [r.y for r in df.collect()] == [False, True]


def test_every_state_has_one_region():
    listed = [s for states in v.REGION_STATES.values() for s in states]
    assert sorted(listed) == sorted(v.STATE_NAMES) and len(listed) == 27
