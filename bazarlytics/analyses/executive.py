"""Headline business metrics over ``fct_orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazarlytics.analyses.common import (
    average,
    delivered,
    detractors,
    orders_count,
    performance,
    promoters,
    rate,
    revenue,
)
from bazarlytics.functions.columns import position, ratio, tier
from bazarlytics.functions.values import ORDER_VALUE_5
from bazarlytics.operators.grouping import ordered, share_of_total


def executive_kpis(orders: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row of revenue, customer, delivery and satisfaction measures.

    A customer is new when the first order of all falls on one of the counted orders'
    days. Partial sums per customer answer that in one pass over the orders, with no
    join of the table to itself.
    """
    wanted = F.col("is_delivered")
    if start is not None:
        wanted = wanted & (F.col("order_date") >= F.lit(start).cast("date"))
    if end is not None:
        wanted = wanted & (F.col("order_date") <= F.lit(end).cast("date"))

    def when(value):
        return F.when(F.col("wanted"), value)

    per_customer = (
        orders.withColumn("wanted", wanted)
        .groupBy("customer_id")
        .agg(
            F.min("order_date").alias("first_ever"),
            F.min(when(F.col("order_date"))).alias("first_counted"),
            F.count(when(F.lit(1))).alias("n"),
            F.sum(when(F.col("total_order_value"))).alias("gmv"),
            *[
                part
                for c in ("days_to_delivery", "days_vs_estimated", "review_score")
                for part in (
                    F.sum(when(F.col(c))).alias(f"{c}_sum"),
                    F.count(when(F.col(c))).alias(f"{c}_n"),
                )
            ],
            F.count(F.when(F.col("wanted") & performance("late"), 1)).alias("late"),
            F.count(F.when(F.col("wanted") & F.col("is_positive_review"), 1)).alias("positive"),
        )
    )
    n = F.sum("n")

    def avg(c: str):
        return ratio(F.sum(f"{c}_sum"), F.sum(f"{c}_n"))

    return per_customer.agg(
        F.sum("gmv").alias("total_gmv"),
        n.alias("total_orders"),
        ratio(F.sum("gmv"), n).alias("avg_order_value"),
        F.count(F.when(F.col("first_counted").isNotNull(), F.col("customer_id"))).alias(
            "total_customers"
        ),
        F.count(
            F.when(F.col("first_counted") == F.col("first_ever"), F.col("customer_id"))
        ).alias("new_customers"),
        avg("days_to_delivery").alias("avg_delivery_days"),
        avg("days_vs_estimated").alias("avg_days_vs_estimated"),
        ratio(F.sum("late"), n, 100).alias("late_delivery_pct"),
        avg("review_score").alias("avg_satisfaction_score"),
        ratio(F.sum("positive"), n, 100).alias("positive_review_pct"),
    )


def revenue_trend(orders: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Monthly revenue with growth against the previous row and the twelfth row before.

    The window sees one row per month, so its single partition stays small.
    """
    monthly = (
        delivered(orders, start, end)
        .groupBy(F.col("order_month").alias("month"))
        .agg(
            orders_count(),
            revenue("monthly_revenue"),
            average("total_order_value", "avg_order_value"),
            F.countDistinct("customer_id").alias("active_customers"),
        )
    )
    by_month = Window.orderBy("month")
    now = F.col("monthly_revenue").cast("double")

    def growth(rows: int):
        return (F.try_divide(now, F.lag(now, rows).over(by_month)) - 1) * 100

    grown = monthly.withColumns({"mom_growth": growth(1), "yoy_growth": growth(12)})
    return ordered(grown, "month")


def customer_acquisition(
    orders: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    firsts = (
        orders.filter("is_delivered").groupBy("customer_id").agg(F.min("order_date").alias("first"))
    )
    if start is not None:
        firsts = firsts.filter(F.col("first") >= F.lit(start).cast("date"))
    if end is not None:
        firsts = firsts.filter(F.col("first") <= F.lit(end).cast("date"))
    return (
        firsts.groupBy(F.trunc("first", "month").alias("month"))
        .agg(F.count("*").alias("new_customers"))
        .transform(ordered, "month")
    )


def order_volume(orders: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return (
        delivered(orders, start, end)
        .groupBy(F.col("order_month").alias("month"))
        .agg(orders_count(), F.countDistinct("customer_id").alias("unique_customers"))
        .withColumn("orders_per_customer", ratio("total_orders", "unique_customers"))
        .transform(ordered, "month")
    )


def order_value_distribution(
    orders: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    return (
        delivered(orders, start, end)
        .groupBy(tier("total_order_value", ORDER_VALUE_5).alias("order_value_range"))
        .agg(orders_count("order_count"), revenue(), average("total_order_value", "avg_order_value"))
        .transform(ordered, position("order_value_range", ORDER_VALUE_5.labels))
    )


def delivery_performance(
    orders: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    return (
        delivered(orders, start, end)
        .groupBy(F.col("order_month").alias("month"))
        .agg(
            average("days_to_delivery", "avg_delivery_days"),
            average("days_vs_estimated"),
            rate(performance("early"), "early_pct"),
            rate(performance("on_time"), "ontime_pct"),
            rate(performance("late"), "late_pct"),
        )
        .transform(ordered, "month")
    )


def delivery_performance_long(
    orders: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    """The three shares of each month as rows."""
    return delivery_performance(orders, start, end).unpivot(
        ["month"], ["early_pct", "ontime_pct", "late_pct"], "performance", "percentage"
    )


def satisfaction_trend(
    orders: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    score = F.col("review_score")
    return (
        delivered(orders, start, end)
        .filter(score.isNotNull())
        .groupBy(F.col("order_month").alias("month"))
        .agg(
            average("review_score"),
            rate(score == 5, "five_star_pct"),
            rate(promoters(), "positive_pct"),
            rate(score == 3, "neutral_pct"),
            rate(detractors(), "negative_pct"),
        )
        .transform(ordered, "month")
    )


def review_distribution(
    orders: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    counted = (
        delivered(orders, start, end)
        .filter(F.col("review_score").isNotNull())
        .groupBy("review_score")
        .agg(F.count("*").alias("review_count"))
    )
    return share_of_total(counted, percentage="review_count").transform(ordered, "review_score")
