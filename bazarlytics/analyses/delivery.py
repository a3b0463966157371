"""Delivery operations over ``fct_orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazarlytics.analyses.common import (
    average,
    delivered,
    orders_count,
    performance,
    promoters,
    rate,
)
from bazarlytics.functions.columns import count_where, mean, position, tier
from bazarlytics.functions.values import DELIVERY_DAYS, DELIVERY_PERFORMANCES, FREIGHT_RANGE
from bazarlytics.operators.grouping import best_and_worst, ordered, top
from bazarlytics.operators.ordering import exact_median


def _arrived(orders: DataFrame, start: str | None, end: str | None) -> DataFrame:
    return delivered(orders, start, end).filter(F.col("days_to_delivery").isNotNull())


def _rates():
    return [
        rate(performance("early"), "early_pct"),
        rate(performance("on_time"), "ontime_pct"),
        rate(performance("late"), "late_pct"),
    ]


def delivery_kpis(orders: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row; the exact median comes from a distributed sort of the one column."""
    arrived = _arrived(orders, start, end)
    return arrived.agg(
        orders_count(),
        average("days_to_delivery", "avg_delivery_days"),
        average("days_vs_estimated"),
        *_rates(),
        count_where(performance("late")).alias("late_orders"),
        average("review_score", "avg_satisfaction"),
        average("total_freight", "avg_freight_cost"),
    ).withColumn("median_delivery_days", exact_median(arrived, "days_to_delivery").scalar())


def delivery_trend(orders: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return (
        _arrived(orders, start, end)
        .groupBy(F.col("order_month").alias("month"))
        .agg(
            orders_count(),
            average("days_to_delivery", "avg_delivery_days"),
            average("days_vs_estimated"),
            *_rates(),
            average("review_score", "avg_satisfaction"),
        )
        .transform(ordered, "month")
    )


def delivery_trend_long(
    orders: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    return delivery_trend(orders, start, end).unpivot(
        ["month"], ["early_pct", "ontime_pct", "late_pct"], "performance", "percentage"
    )


def state_delivery(
    orders: DataFrame, start: str | None = None, end: str | None = None, min_orders: int = 100
) -> DataFrame:
    return (
        _arrived(orders, start, end)
        .filter(F.col("customer_state").isNotNull())
        .groupBy("customer_state")
        .agg(
            orders_count(),
            average("days_to_delivery", "avg_delivery_days"),
            average("days_vs_estimated"),
            rate(performance("late"), "late_pct"),
            average("review_score", "avg_satisfaction"),
            average("total_freight", "avg_freight_cost"),
        )
        .filter(F.col("total_orders") >= min_orders)
        .transform(ordered, "avg_delivery_days", "customer_state")
    )


def state_delivery_extremes(
    orders: DataFrame,
    start: str | None = None,
    end: str | None = None,
    min_orders: int = 100,
    n: int = 10,
) -> DataFrame:
    return best_and_worst(
        state_delivery(orders, start, end, min_orders),
        n,
        [F.asc("avg_delivery_days"), F.col("customer_state")],
        [F.desc("avg_delivery_days"), F.col("customer_state")],
    )


def latest_states(
    orders: DataFrame,
    start: str | None = None,
    end: str | None = None,
    min_orders: int = 100,
    n: int = 15,
) -> DataFrame:
    states = state_delivery(orders, start, end, min_orders)
    return top(states, n, F.desc("late_pct"), "customer_state")


def satisfaction_by_delivery_time(
    orders: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    return (
        _arrived(orders, start, end)
        .filter(F.col("review_score").isNotNull())
        .groupBy(tier("days_to_delivery", DELIVERY_DAYS).alias("delivery_time_bucket"))
        .agg(
            orders_count("order_count"),
            average("review_score", "avg_satisfaction"),
            rate(promoters(), "positive_review_pct"),
            average("days_to_delivery", "avg_delivery_days"),
        )
        .transform(ordered, position("delivery_time_bucket", DELIVERY_DAYS.labels))
    )


def satisfaction_by_performance(
    orders: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    return (
        delivered(orders, start, end)
        .filter(F.col("review_score").isNotNull() & F.col("delivery_performance").isNotNull())
        .groupBy("delivery_performance")
        .agg(
            orders_count("order_count"),
            average("review_score", "avg_satisfaction"),
            average("days_to_delivery", "avg_delivery_days"),
            average("days_vs_estimated"),
        )
        .transform(ordered, position("delivery_performance", DELIVERY_PERFORMANCES))
    )


def freight_and_delivery(
    orders: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    return (
        _arrived(orders, start, end)
        .filter(F.col("total_freight").isNotNull())
        .groupBy(tier("total_freight", FREIGHT_RANGE).alias("freight_range"))
        .agg(
            orders_count("order_count"),
            average("total_freight", "avg_freight"),
            average("days_to_delivery", "avg_delivery_days"),
            rate(performance("late"), "late_pct"),
            average("review_score", "avg_satisfaction"),
        )
        .transform(ordered, position("freight_range", FREIGHT_RANGE.labels))
    )


def fulfillment_cycle(
    orders: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    approval = F.col("hours_to_approval") / 24.0
    return (
        _arrived(orders, start, end)
        .filter(F.col("hours_to_approval").isNotNull())
        .groupBy(F.col("order_month").alias("month"))
        .agg(
            mean(approval).alias("avg_days_to_approval"),
            average("days_to_delivery", "avg_days_to_delivery"),
            mean(approval + F.col("days_to_delivery")).alias("total_cycle_time"),
            orders_count("order_count"),
        )
        .transform(ordered, "month")
    )


def fulfillment_cycle_long(
    orders: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    return fulfillment_cycle(orders, start, end).unpivot(
        ["month"], ["avg_days_to_approval", "avg_days_to_delivery"], "stage", "days"
    )
