"""Cancellation and payment risk over all orders of ``fct_orders``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazarlytics.analyses.common import average, in_period, orders_count, rate, revenue
from bazarlytics.functions.columns import case, count_where, mean, position, sum_where, tier
from bazarlytics.functions.values import (
    INSTALLMENT_GROUP_STEPS,
    INSTALLMENT_RANGE_OTHER,
    ORDER_VALUE_5,
)
from bazarlytics.operators.grouping import ordered, share_of_total, top


def _canceled() -> Column:
    return F.col("is_canceled")


def _cancellations() -> list[Column]:
    return [
        orders_count(),
        count_where(_canceled()).alias("canceled_orders"),
        rate(_canceled(), "cancellation_rate"),
    ]


def cancellation_kpis(
    orders: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    value = F.col("total_order_value")
    return in_period(orders, start, end).agg(
        *_cancellations(),
        count_where(F.col("is_delivered")).alias("delivered_orders"),
        sum_where(_canceled(), value).alias("canceled_revenue"),
        mean(F.when(_canceled(), value)).alias("avg_canceled_order_value"),
        mean(F.when(F.col("is_delivered"), value)).alias("avg_delivered_order_value"),
    )


def cancellation_trend(
    orders: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    return (
        in_period(orders, start, end)
        .groupBy(F.col("order_month").alias("month"))
        .agg(
            *_cancellations(), sum_where(_canceled(), "total_order_value").alias("canceled_revenue")
        )
        .transform(ordered, "month")
    )


def cancellation_by_value(
    orders: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    return (
        in_period(orders, start, end)
        .groupBy(tier("total_order_value", ORDER_VALUE_5).alias("order_value_range"))
        .agg(*_cancellations(), average("total_order_value", "avg_order_value"))
        .transform(ordered, position("order_value_range", ORDER_VALUE_5.labels))
    )


def cancellation_by_state(
    orders: DataFrame, start: str | None = None, end: str | None = None, min_orders: int = 100
) -> DataFrame:
    return (
        in_period(orders, start, end)
        .filter(F.col("customer_state").isNotNull())
        .groupBy("customer_state")
        .agg(*_cancellations(), average("total_order_value", "avg_order_value"))
        .filter(F.col("total_orders") >= min_orders)
        .transform(ordered, F.desc("cancellation_rate"), "customer_state")
    )


def riskiest_states(
    orders: DataFrame,
    start: str | None = None,
    end: str | None = None,
    min_orders: int = 100,
    n: int = 15,
) -> DataFrame:
    states = cancellation_by_state(orders, start, end, min_orders)
    return top(states, n, F.desc("cancellation_rate"), "customer_state")


def cancellation_by_payment(
    orders: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    return (
        in_period(orders, start, end)
        .filter(F.col("primary_payment_method").isNotNull())
        .groupBy("primary_payment_method")
        .agg(*_cancellations())
        .transform(ordered, F.desc("cancellation_rate"), "primary_payment_method")
    )


def installment_distribution(
    orders: DataFrame,
    start: str | None = None,
    end: str | None = None,
    max_installments: int | None = None,
) -> DataFrame:
    """Orders by installment count; shares refer to all counts, also with an upper bound."""
    counts = (
        in_period(orders, start, end)
        .filter(F.col("max_installments").isNotNull())
        .groupBy("max_installments")
        .agg(
            orders_count("order_count"),
            revenue(),
            average("total_order_value", "avg_order_value"),
            rate(_canceled(), "cancellation_rate"),
            mean(F.when(F.col("is_delivered"), F.col("review_score"))).alias("avg_satisfaction"),
        )
    )
    shared = share_of_total(counts, order_pct="order_count")
    if max_installments is not None:
        shared = shared.filter(F.col("max_installments") <= max_installments)
    return shared.transform(ordered, "max_installments")


def installment_groups(
    orders: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    """The distribution regrouped; every installment count weighs alike in the means."""
    parts = F.col("max_installments")
    steps = [
        (parts == high if low is not None else parts <= high, label)
        for low, high, label in INSTALLMENT_GROUP_STEPS
    ]
    labels = [label for *_, label in INSTALLMENT_GROUP_STEPS]
    return (
        installment_distribution(orders, start, end)
        .groupBy(case(steps, INSTALLMENT_RANGE_OTHER).alias("installment_group"))
        .agg(
            F.sum("order_count").alias("order_count"),
            F.sum("total_revenue").alias("total_revenue"),
            F.avg("avg_order_value").alias("avg_order_value"),
            F.avg("cancellation_rate").alias("cancellation_rate"),
            F.avg("avg_satisfaction").alias("avg_satisfaction"),
        )
        .transform(ordered, position("installment_group", labels))
    )


def payment_failure(orders: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return (
        in_period(orders, start, end)
        .filter(F.col("primary_payment_method").isNotNull())
        .groupBy("primary_payment_method")
        .agg(
            orders_count(),
            count_where(_canceled()).alias("failed_orders"),
            rate(_canceled(), "failure_rate"),
            average("max_installments", "avg_installments"),
            average("total_order_value", "avg_order_value"),
        )
        .transform(ordered, F.desc("failure_rate"), "primary_payment_method")
    )


def payment_failure_by_state(
    orders: DataFrame,
    start: str | None = None,
    end: str | None = None,
    min_orders: int = 50,
    n: int = 30,
) -> DataFrame:
    pairs = (
        in_period(orders, start, end)
        .filter(F.col("customer_state").isNotNull() & F.col("primary_payment_method").isNotNull())
        .groupBy("customer_state", "primary_payment_method")
        .agg(
            orders_count(),
            count_where(_canceled()).alias("failed_orders"),
            rate(_canceled(), "failure_rate"),
        )
        .filter(F.col("total_orders") >= min_orders)
    )
    return top(pairs, n, F.desc("failure_rate"), "customer_state", "primary_payment_method")
