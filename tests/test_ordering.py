"""Distributed order statistics equal the single-partition windows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from bazarlytics.operators.grouping import best_and_worst, share_of_total, value_profile
from bazarlytics.operators.ordering import (
    exact_median,
    number_rows,
    number_rows_within,
    running_total,
    with_ntiles,
    with_percent_rank,
)


def same(left, right):
    columns = sorted(right.columns)
    a, b = left.select(columns), right.select(columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_row_numbers_are_dense_and_ordered(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("v"))
    rows = number_rows(df, ["v"]).orderBy("row_num").collect()
    assert [r.row_num for r in rows] == list(range(1, 5001))
    assert [r.v for r in rows] == sorted(r.v for r in rows)


def test_row_numbers_within_a_hot_key(spark):
    # one key holds a third of the rows
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 50).alias("k"),
        ((F.col("id") * 31) % 3001).alias("v"),
    )
    expected = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("v")))
    same(number_rows_within(df, ["k"], ["v"], "n"), expected)


def test_running_total(spark):
    df = spark.range(2000).select(((F.col("id") * 7919) % 2003).alias("v"), (F.col("id") % 7).alias("n"))
    expected = df.withColumn("t", F.sum("n").over(Window.orderBy("v")))
    same(running_total(df, ["v"], "n", "t"), expected)


def test_median_and_rank_of_a_hot_value(spark):
    # two thirds of the rows share one value
    df = spark.range(9000).select("id", F.when(F.col("id") % 3 > 0, 50).otherwise(F.col("id") % 101).alias("v"))
    same(exact_median(df, "v"), df.agg(F.median("v").alias("median")))
    same(with_percent_rank(df, "v", "p"), df.withColumn("p", F.percent_rank().over(Window.orderBy("v"))))


def test_median_of_nothing_is_unknown(frame):
    assert exact_median(frame([(None,)], "v double"), "v").first().median is None


@pytest.mark.parametrize("size", [0, 1, 3, 4, 5, 6, 12, 103])
def test_ntiles(spark, size):
    df = spark.range(size).select(
        F.format_string("c%03d", (F.col("id") * 37) % 1009).alias("c"), (F.col("id") % 4).alias("v")
    )
    expected = df.withColumn("t", F.ntile(5).over(Window.orderBy("v", "c")))
    same(with_ntiles(df, {"t": "v"}, "c"), expected)


def test_ntiles_skip_unknown_values(frame):
    rows = [(f"c{i:02d}", v) for i, v in enumerate([3, 3, 3, None, 1, 1, 1, None, 2, 2, 2, 5])]
    df = frame(rows, "c string, v int")
    out = {r.c: r.t for r in with_ntiles(df, {"t": "v"}, "c").collect()}
    known = df.filter("v is not null").withColumn("t", F.ntile(5).over(Window.orderBy("v", "c")))
    assert {c: t for c, t in out.items() if t is not None} == {r.c: r.t for r in known.collect()}
    assert out["c03"] is None and out["c07"] is None


@pytest.mark.parametrize("size", [1, 2, 9, 200])
def test_percent_rank_with_ties(spark, size):
    df = spark.range(size).select("id", (F.col("id") % 5).alias("v"))
    expected = df.withColumn("p", F.percent_rank().over(Window.orderBy("v")))
    same(with_percent_rank(df, "v", "p"), expected)


@pytest.mark.parametrize("values, middle", [([5.0], 5.0), ([1.0, 4.0], 2.5), ([3.0, None, 1.0, 9.0], 3.0), ([2.0] * 7 + [8.0], 2.0)])
def test_exact_median(frame, values, middle):
    df = frame([(v,) for v in values], "v double")
    assert exact_median(df, "v").first().median == middle


def test_mode_takes_the_smallest_tie_and_ignores_null(frame):
    rows = [("a", x) for x in ["z", "b", "b", "z", None, None, None]] + [("n", None)]
    out = value_profile(frame(rows, "k string, x string"), ["k"], "x", "kinds", "usual")
    assert {r.k: (r.kinds, r.usual) for r in out.collect()} == {"a": (2, "b"), "n": (0, None)}


def test_shares_add_up(frame):
    out = share_of_total(frame([("a", 1), ("b", 3)], "k string, n int"), pct="n")
    assert {r.k: r.pct for r in out.collect()} == {"a": 25.0, "b": 75.0}


def test_best_and_worst_repeats_rows_of_short_inputs(frame):
    df = frame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    out = best_and_worst(df, 2, [F.desc("v")], [F.asc("v")]).collect()
    assert [(r.k, r.side) for r in out] == [("c", "best"), ("b", "best"), ("a", "worst"), ("b", "worst")]
