"""Approximate customers and order values of any period from one small row per day.

A day keeps a HyperLogLog sketch of its customers and a KLL sketch of its order values. Both
have a fixed size and merge, so months and years are answered from the days' rows and not from
the orders, and a new day never touches older ones. The exact analyses stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazarlytics.operators.grouping import ordered

LOG_BUCKETS = 14  # relative standard error of a distinct count about 0.8 %
KLL_SIZE = 400  # error of a rank about 0.7 % of the rows
# three standard errors of the one, and as much of the other
CUSTOMERS_WITHIN, RANK_WITHIN = 0.025, 0.02


def daily_sketches(orders: DataFrame, customer_key: str = "customer_id", value: str = "total_order_value") -> DataFrame:
    """order_date, order_rows, customers and order_values of every day with orders.

    Null customers and null values do not count; rows without a day are left out. A day without
    any value has no value sketch.
    """
    known = F.col(value).cast("double")
    return (
        orders.where(F.col("order_date").isNotNull())
        .groupBy("order_date")
        .agg(
            F.count("*").alias("order_rows"),
            F.hll_sketch_agg(F.col(customer_key), LOG_BUCKETS).alias("customers"),
            F.when(F.count(known) > 0, F.kll_sketch_agg_double(known, KLL_SIZE)).alias("order_values"),
        )
    )


def merge(sketches: DataFrame, *by: str | Column) -> DataFrame:
    """Sketches of larger groups, such as months of days, or of tables put together by day."""
    return sketches.groupBy(*by).agg(
        F.sum("order_rows").alias("order_rows"),
        F.hll_union_agg("customers").alias("customers"),
        F.when(F.count("order_values") > 0, F.kll_merge_agg_double("order_values")).alias("order_values"),
    )


def by_month(daily: DataFrame) -> DataFrame:
    return merge(daily, F.trunc("order_date", "month").alias("order_month"))


def estimates(sketches: DataFrame, *keys: str) -> DataFrame:
    """order_rows, customers and the quartiles of the order values, read from sketches."""
    quartiles = F.kll_sketch_get_quantile_double("order_values", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return sketches.select(*keys, "order_rows", F.hll_sketch_estimate("customers").alias("customers"), quartiles.alias("q")).select(
        *keys, "order_rows", "customers", *(F.get("q", i).alias(n) for i, n in enumerate(("value_p25", "median_value", "value_p75")))
    )


def monthly_estimates(daily: DataFrame) -> DataFrame:
    return estimates(by_month(daily), "order_month").transform(ordered, "order_month")


def checked_months(
    daily: DataFrame, orders: DataFrame, customer_key: str = "customer_id", value: str = "total_order_value"
) -> DataFrame:
    """The exact customers and rows of every month, and whether the sketches came close.

    A median is close when the rows below and up to it leave the half within RANK_WITHIN, also
    where many rows share the value. It is close by definition where a month has no values.
    """
    told = monthly_estimates(daily).select("order_month", F.col("customers").alias("told"), "median_value")
    month = F.trunc("order_date", "month")
    # as many rows as months
    rows = orders.where(F.col("order_date").isNotNull()).select(
        month.alias("order_month"), F.col(customer_key).alias("c"), F.col(value).cast("double").alias("v")
    )
    places = (
        rows.join(told, "order_month")
        .groupBy("order_month", "told")
        .agg(
            F.count("*").alias("order_rows"),
            F.count("v").alias("n"),
            F.count_if(F.col("v") < F.col("median_value")).alias("below"),
            F.count_if(F.col("v") <= F.col("median_value")).alias("up_to"),
        )
    )
    distinct = rows.groupBy("order_month", "c").count().groupBy("order_month").agg(F.count("c").alias("customers"))
    low, high = F.col("below") / F.col("n") - RANK_WITHIN, F.col("up_to") / F.col("n") + RANK_WITHIN
    return (
        places.join(distinct, "order_month")
        .select(
            "order_month",
            "order_rows",
            "customers",
            (F.abs(F.col("told") - F.col("customers")) <= CUSTOMERS_WITHIN * F.col("customers")).alias("customers_close"),
            ((F.col("n") == 0) | ((low <= 0.5) & (high >= 0.5))).alias("median_close"),
        )
        .transform(ordered, "order_month")
    )
