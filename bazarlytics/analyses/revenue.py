"""Revenue, payment and freight analyses over ``fct_orders``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazarlytics.analyses.common import average, delivered, orders_count, revenue
from bazarlytics.functions.columns import case, col, day_gap, mean, position, ratio, tier
from bazarlytics.functions.values import (
    DELIVERY_SPEED,
    INSTALLMENT_RANGE_OTHER,
    INSTALLMENT_RANGES,
    ORDER_COUNT_LTV,
    ORDER_VALUE_4,
    ORDER_VALUE_7,
)
from bazarlytics.operators.grouping import ordered, share_of_total


def payment_mix(orders: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    mix = (
        delivered(orders, start, end)
        .filter(F.col("primary_payment_method").isNotNull())
        .groupBy("primary_payment_method")
        .agg(
            orders_count("order_count"),
            F.sum("total_payment_value").alias("total_revenue"),
            average("total_payment_value", "avg_order_value"),
            average("max_installments", "avg_installments"),
        )
    )
    shares = share_of_total(mix, pct_of_orders="order_count", pct_of_revenue="total_revenue")
    return shares.transform(ordered, F.desc("order_count"), "primary_payment_method")


def installment_range(count: Column | str) -> Column:
    count = col(count)
    return case(
        [(count.between(low, high), label) for low, high, label in INSTALLMENT_RANGES],
        INSTALLMENT_RANGE_OTHER,
    )


def installments(orders: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Installment ranges and the revenue share outstanding after the first payment."""
    labels = [label for _, _, label in INSTALLMENT_RANGES]
    parts = F.col("avg_installments")
    return (
        delivered(orders, start, end)
        .filter(F.col("max_installments").isNotNull())
        .groupBy(installment_range("max_installments").alias("installment_range"))
        .agg(
            orders_count("order_count"),
            F.sum("total_payment_value").alias("total_revenue"),
            average("total_payment_value", "avg_order_value"),
            average("max_installments", "avg_installments"),
        )
        .withColumn(
            "working_capital_impact",
            F.try_divide(F.col("total_revenue").cast("double") * (parts - 1), parts),
        )
        .transform(ordered, position("installment_range", labels))
    )


def order_value_tiers(
    orders: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    tiers = (
        delivered(orders, start, end)
        .groupBy(tier("total_order_value", ORDER_VALUE_7).alias("value_range"))
        .agg(orders_count("order_count"), revenue(), average("total_order_value", "avg_order_value"))
    )
    shares = share_of_total(tiers, pct_orders="order_count", pct_revenue="total_revenue")
    return shares.transform(ordered, position("value_range", ORDER_VALUE_7.labels))


def freight_burden(orders: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return (
        delivered(orders, start, end)
        .filter(F.col("total_order_value") > 0)
        .groupBy(tier("total_order_value", ORDER_VALUE_4).alias("order_value_range"))
        .agg(
            orders_count("order_count"),
            average("total_freight", "avg_freight"),
            average("total_order_value", "avg_order_value"),
            mean(ratio("total_freight", "total_order_value", 100)).alias("avg_freight_pct"),
        )
        .transform(ordered, position("order_value_range", ORDER_VALUE_4.labels))
    )


def seasonality(orders: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return (
        delivered(orders, start, end)
        .groupBy(
            F.month("order_date").alias("month_num"),
            F.date_format("order_date", "MMM").alias("month_name"),
        )
        .agg(orders_count("order_count"), revenue(), average("total_order_value", "avg_order_value"))
        .transform(ordered, "month_num")
    )


def per_customer(orders: DataFrame, start: str | None, end: str | None, key: str) -> DataFrame:
    """Delivered orders per customer; ``key`` may name the person instead of the account."""
    return (
        delivered(orders, start, end)
        .groupBy(key)
        .agg(
            F.count("*").alias("order_count"),
            F.sum("total_order_value").alias("lifetime_value"),
            mean("total_order_value").alias("aov"),
            F.min("order_date").alias("first_order_date"),
            F.max("order_date").alias("last_order_date"),
        )
        .withColumn("tenure", day_gap("first_order_date", "last_order_date"))
    )


def lifetime_value(
    orders: DataFrame,
    start: str | None = None,
    end: str | None = None,
    customer_key: str = "customer_id",
) -> DataFrame:
    return (
        per_customer(orders, start, end, customer_key)
        .groupBy(tier("order_count", ORDER_COUNT_LTV).alias("customer_segment"))
        .agg(
            F.count("*").alias("customer_count"),
            average("lifetime_value", "avg_ltv"),
            F.sum("lifetime_value").alias("total_revenue"),
            average("aov", "avg_order_value"),
            average("tenure", "avg_tenure_days"),
        )
        .transform(ordered, position("customer_segment", ORDER_COUNT_LTV.labels))
    )


def delivery_speed_revenue(
    orders: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    return (
        delivered(orders, start, end)
        .filter(F.col("days_to_delivery").isNotNull())
        .groupBy(tier("days_to_delivery", DELIVERY_SPEED).alias("delivery_speed"))
        .agg(
            orders_count("order_count"),
            revenue(),
            average("total_order_value", "avg_order_value"),
            average("review_score"),
            average("total_freight", "avg_freight"),
        )
        .transform(ordered, position("delivery_speed", DELIVERY_SPEED.labels))
    )
