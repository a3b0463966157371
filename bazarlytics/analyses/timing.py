"""When orders come in, and which customers to win back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazarlytics.analyses.common import average, delivered, orders_count, revenue
from bazarlytics.functions.columns import day_of_week, position, tier
from bazarlytics.functions.values import DORMANCY, DORMANT_VALUE, REACTIVATION
from bazarlytics.operators.grouping import ordered


def _volume():
    return [orders_count(), revenue(), average("total_order_value", "avg_order_value")]


def by_day_of_week(orders: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return (
        delivered(orders, start, end)
        .groupBy(
            day_of_week("order_date").alias("day_of_week_num"),
            F.date_format("order_date", "EEEE").alias("day_of_week"),
        )
        .agg(*_volume())
        .transform(ordered, "day_of_week_num")
    )


def by_month_of_year(
    orders: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    return (
        delivered(orders, start, end)
        .groupBy(
            F.month("order_date").alias("month_num"),
            F.date_format("order_date", "MMMM").alias("month_name"),
        )
        .agg(*_volume(), F.countDistinct("customer_id").alias("unique_customers"))
        .transform(ordered, "month_num")
    )


def by_quarter(orders: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return (
        delivered(orders, start, end)
        .groupBy(F.quarter("order_date").alias("quarter"), F.year("order_date").alias("year"))
        .agg(*_volume())
        .withColumn("period", F.concat(F.col("year"), F.lit(" Q"), F.col("quarter")))
        .transform(ordered, "year", "quarter")
    )


def by_hour(orders: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return (
        delivered(orders, start, end)
        .filter(F.col("order_purchase_timestamp").isNotNull())
        .groupBy(F.hour("order_purchase_timestamp").alias("hour"))
        .agg(*_volume())
        .transform(ordered, "hour")
    )


def peaks(orders: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Busiest weekday, best-selling month and busiest hour; the first one on a tie."""

    def peak(df: DataFrame, kind: str, label: str, measure: str, rank: str) -> DataFrame:
        best = F.max_by(
            F.col(label).cast("string"), F.struct(F.col(measure), -F.col(rank).cast("int"))
        )
        return df.agg(best.alias("value")).select(F.lit(kind).alias("peak"), "value")

    days = by_day_of_week(orders, start, end)
    months = by_month_of_year(orders, start, end)
    hours = by_hour(orders, start, end)
    return (
        peak(days, "day_of_week", "day_of_week", "total_orders", "day_of_week_num")
        .unionByName(peak(months, "month", "month_name", "total_revenue", "month_num"))
        .unionByName(peak(hours, "hour", "hour", "total_orders", "hour"))
    )


def _joined_in(customers: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Customers whose first order lies in the period, midnight to midnight."""
    first = F.col("first_order_date")
    if start is not None:
        customers = customers.filter(first >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        customers = customers.filter(first <= F.lit(end).cast("timestamp_ntz"))
    return customers


def reactivation_segments(
    customers: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    return (
        _joined_in(customers, start, end)
        .filter(F.col("days_since_last_order").isNotNull())
        .groupBy(tier("days_since_last_order", REACTIVATION).alias("reactivation_segment"))
        .agg(
            F.count("*").alias("customer_count"),
            average("lifetime_orders", "avg_orders"),
            average("avg_review_score", "avg_satisfaction"),
        )
        .transform(ordered, position("reactivation_segment", REACTIVATION.labels))
    )


def dormant_value(
    customers: DataFrame, orders: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Repeat customers without a recent order, by dormancy and delivered value."""
    spent = (
        orders.filter("is_delivered")
        .groupBy("customer_id")
        .agg(F.sum("total_order_value").alias("lifetime_value"))
    )
    return (
        _joined_in(customers, start, end)
        .filter((F.col("days_since_last_order") >= 90) & (F.col("lifetime_orders") >= 2))
        .select("customer_id", "days_since_last_order")
        .join(spent, "customer_id")
        .groupBy(
            tier("days_since_last_order", DORMANCY).alias("segment"),
            tier("lifetime_value", DORMANT_VALUE).alias("value_segment"),
        )
        .agg(F.count("*").alias("customer_count"), average("lifetime_value", "avg_ltv"))
        .transform(ordered, "segment", F.desc("avg_ltv"))
    )
