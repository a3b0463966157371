"""Review and satisfaction analyses over ``fct_orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazarlytics.analyses.common import (
    average,
    delivered,
    detractors,
    orders_count,
    promoters,
    rate,
)
from bazarlytics.functions.columns import count_where, position, ratio, tier
from bazarlytics.functions.values import (
    DELIVERY_DAYS,
    DELIVERY_PERFORMANCES,
    FREIGHT_SEGMENT,
    ORDER_VALUE_4,
)
from bazarlytics.operators.grouping import best_and_worst, ordered

STARS = {"five_star": 5, "four_star": 4, "three_star": 3, "two_star": 2, "one_star": 1}


def _reviewed(orders: DataFrame, start: str | None, end: str | None) -> DataFrame:
    return delivered(orders, start, end).filter(F.col("review_score").isNotNull())


def satisfaction_kpis(
    orders: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    score = F.col("review_score")
    return (
        _reviewed(orders, start, end)
        .agg(
            orders_count("total_orders_with_reviews"),
            average("review_score"),
            rate(promoters(), "promoters_pct"),
            rate(score == 3, "passives_pct"),
            rate(detractors(), "detractors_pct"),
            *[count_where(score == n).alias(name) for name, n in STARS.items()],
        )
        .withColumn("nps", F.col("promoters_pct") - F.col("detractors_pct"))
    )


def rating_distribution(
    orders: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Stars as rows with their share of all reviews."""
    wide = satisfaction_kpis(orders, start, end)
    long = wide.unpivot(["total_orders_with_reviews"], list(STARS), "star", "count")
    rating = F.element_at(
        F.create_map(*[F.lit(x) for pair in STARS.items() for x in pair]), F.col("star")
    )
    return long.select(
        rating.alias("rating"),
        "count",
        ratio("count", "total_orders_with_reviews", 100).alias("percentage"),
    ).transform(ordered, F.desc("rating"))


def nps_trend(orders: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return (
        _reviewed(orders, start, end)
        .groupBy(F.col("order_month").alias("month"))
        .agg(
            orders_count("total_reviews"),
            average("review_score", "avg_rating"),
            rate(promoters(), "promoters_pct"),
            rate(detractors(), "detractors_pct"),
        )
        .withColumn("nps", F.col("promoters_pct") - F.col("detractors_pct"))
        .transform(ordered, "month")
    )


def rating_by_performance(
    orders: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    return (
        _reviewed(orders, start, end)
        .filter(F.col("delivery_performance").isNotNull())
        .groupBy("delivery_performance")
        .agg(
            orders_count("order_count"),
            average("review_score", "avg_rating"),
            rate(promoters(), "positive_pct"),
            rate(detractors(), "negative_pct"),
            average("days_to_delivery", "avg_delivery_days"),
        )
        .transform(ordered, position("delivery_performance", DELIVERY_PERFORMANCES))
    )


def rating_by_delivery_time(
    orders: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    return (
        _reviewed(orders, start, end)
        .filter(F.col("days_to_delivery").isNotNull())
        .groupBy(tier("days_to_delivery", DELIVERY_DAYS).alias("delivery_bucket"))
        .agg(
            average("days_to_delivery", "avg_days"),
            orders_count("order_count"),
            average("review_score", "avg_rating"),
            rate(promoters(), "positive_pct"),
        )
        .transform(ordered, position("delivery_bucket", DELIVERY_DAYS.labels))
    )


def state_satisfaction(
    orders: DataFrame, start: str | None = None, end: str | None = None, min_orders: int = 100
) -> DataFrame:
    return (
        _reviewed(orders, start, end)
        .filter(F.col("customer_state").isNotNull())
        .groupBy("customer_state")
        .agg(
            orders_count(),
            average("review_score", "avg_rating"),
            rate(promoters(), "promoters_pct"),
            rate(detractors(), "detractors_pct"),
            average("days_to_delivery", "avg_delivery_days"),
            average("total_order_value", "avg_order_value"),
        )
        .filter(F.col("total_orders") >= min_orders)
        .withColumn("nps", F.col("promoters_pct") - F.col("detractors_pct"))
        .transform(ordered, F.desc("avg_rating"), "customer_state")
    )


def state_satisfaction_extremes(
    orders: DataFrame,
    start: str | None = None,
    end: str | None = None,
    min_orders: int = 100,
    n: int = 10,
) -> DataFrame:
    return best_and_worst(
        state_satisfaction(orders, start, end, min_orders),
        n,
        [F.desc("avg_rating"), F.col("customer_state")],
        [F.asc("avg_rating"), F.col("customer_state")],
    )


def satisfaction_factors(
    orders: DataFrame, start: str | None = None, end: str | None = None, min_orders: int = 10
) -> DataFrame:
    return (
        _reviewed(orders, start, end)
        .groupBy(
            tier("total_order_value", ORDER_VALUE_4).alias("order_value_segment"),
            "primary_payment_method",
            "delivery_performance",
            tier("total_freight", FREIGHT_SEGMENT).alias("freight_segment"),
        )
        .agg(
            orders_count("order_count"),
            average("review_score", "avg_rating"),
            rate(promoters(), "positive_pct"),
        )
        .filter(F.col("order_count") >= min_orders)
    )


def factors_by(
    orders: DataFrame,
    factor: str,
    start: str | None = None,
    end: str | None = None,
    min_orders: int = 10,
) -> DataFrame:
    """The factor grid regrouped by one factor; cell means count alike."""
    return (
        satisfaction_factors(orders, start, end, min_orders)
        .filter(F.col(factor).isNotNull())
        .groupBy(factor)
        .agg(
            F.sum("order_count").alias("order_count"),
            F.avg("avg_rating").alias("avg_rating"),
            F.avg("positive_pct").alias("positive_pct"),
        )
        .transform(ordered, *_factor_order(factor))
    )


def _factor_order(factor: str):
    if factor == "order_value_segment":
        return [position(factor, ORDER_VALUE_4.labels)]
    if factor == "freight_segment":
        return [position(factor, FREIGHT_SEGMENT.labels)]
    return [F.desc("avg_rating"), F.col(factor)]
