"""Seller analyses over ``mart_seller_scorecard`` (one row per seller)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazarlytics.analyses.common import average, where
from bazarlytics.functions.columns import position
from bazarlytics.functions.values import (
    DIVERSITY_TYPE,
    SELLER_ACTIVITY_ORDER,
    SELLER_HEALTH_ORDER,
)
from bazarlytics.operators.grouping import ordered, top


def _chosen(
    mart: DataFrame,
    health: str | None = None,
    activity: str | None = None,
    region: str | None = None,
    min_orders: int = 1,
) -> DataFrame:
    busy = mart.filter(F.col("total_orders") >= min_orders)
    return where(busy, seller_health=health, activity_status=activity, region=region)


def _sellers(name: str = "seller_count"):
    return F.count("seller_id").alias(name)


def value_list(mart: DataFrame, column: str) -> DataFrame:
    """Distinct known values of a filter column: seller_health, activity_status or region."""
    return ordered(mart.filter(F.col(column).isNotNull()).select(column).distinct(), column)


def marketplace_kpis(mart: DataFrame, **chosen) -> DataFrame:
    return _chosen(mart, **chosen).agg(
        _sellers("total_sellers"),
        F.sum("total_revenue").alias("total_revenue"),
        F.sum("total_orders").alias("total_orders"),
        average("avg_review_score", "avg_review_score"),
        average("on_time_delivery_rate", "avg_on_time_rate"),
        average("overall_performance_score", "avg_performance_score"),
    )


def top_sellers(mart: DataFrame, n: int = 20, **chosen) -> DataFrame:
    scored = _chosen(mart, **chosen).filter(F.col("overall_performance_score").isNotNull())
    return top(scored, n, F.desc("overall_performance_score"), "seller_id").select(
        "seller_id",
        "seller_state",
        "region",
        "total_orders",
        "total_revenue",
        "avg_review_score",
        "on_time_delivery_rate",
        "overall_performance_score",
        "seller_health",
        "activity_status",
        "seller_performance_tier",
    )


def health_distribution(mart: DataFrame, min_orders: int = 1) -> DataFrame:
    return (
        _chosen(mart, min_orders=min_orders)
        .groupBy("seller_health")
        .agg(
            _sellers(),
            F.sum("total_revenue").alias("total_revenue"),
            average("total_orders", "avg_orders"),
            average("avg_review_score", "avg_review"),
            average("on_time_delivery_rate", "avg_on_time_rate"),
        )
        .transform(ordered, position("seller_health", SELLER_HEALTH_ORDER))
    )


def activity_distribution(mart: DataFrame, min_orders: int = 1) -> DataFrame:
    return (
        _chosen(mart, min_orders=min_orders)
        .groupBy("activity_status")
        .agg(
            _sellers(),
            F.sum("total_revenue").alias("total_revenue"),
            average("orders_last_30_days", "avg_orders_30d"),
            average("orders_last_90_days", "avg_orders_90d"),
        )
        .transform(ordered, position("activity_status", SELLER_ACTIVITY_ORDER))
    )


def revenue_by_tier(mart: DataFrame, **chosen) -> DataFrame:
    return (
        _chosen(mart, **chosen)
        .filter(F.col("seller_performance_tier").isNotNull())
        .groupBy("seller_performance_tier")
        .agg(
            _sellers(),
            F.sum("total_revenue").alias("total_revenue"),
            average("revenue_per_order"),
            average("revenue_per_day_active", "avg_revenue_per_day"),
            average("total_orders", "avg_orders"),
        )
        .transform(ordered, "seller_performance_tier")
    )


def top_by_percentile(mart: DataFrame, n: int = 100, **chosen) -> DataFrame:
    ranked = _chosen(mart, **chosen).filter(F.col("revenue_percentile").isNotNull())
    return top(ranked, n, F.desc("revenue_percentile"), "seller_id").select(
        "seller_id",
        "seller_state",
        "total_revenue",
        "revenue_per_order",
        "revenue_per_month",
        "revenue_percentile",
        "seller_performance_tier",
    )


def percentile_histogram(mart: DataFrame, bins: int = 20, **chosen) -> DataFrame:
    """Sellers per equal-width percentile bin; 100 belongs to the last bin."""
    width = 100.0 / bins
    ranked = _chosen(mart, **chosen).filter(F.col("revenue_percentile").isNotNull())
    place = F.least(F.floor(F.col("revenue_percentile") / width), F.lit(bins - 1))
    return (
        ranked.groupBy(place.alias("bin"))
        .agg(_sellers())
        .select("bin", (F.col("bin") * width).alias("from_percentile"), "seller_count")
        .transform(ordered, "bin")
    )


def specialization(mart: DataFrame, min_orders: int = 1) -> DataFrame:
    return (
        _chosen(mart, min_orders=min_orders)
        .filter(F.col("product_diversity_type").isNotNull())
        .groupBy("product_diversity_type")
        .agg(
            _sellers(),
            average("unique_products_sold", "avg_products"),
            average("unique_categories", "avg_categories"),
            average("total_revenue", "avg_revenue"),
            average("avg_review_score", "avg_review"),
        )
        .transform(ordered, position("product_diversity_type", DIVERSITY_TYPE.labels))
    )


def region_summary(mart: DataFrame, min_orders: int = 1) -> DataFrame:
    return (
        _chosen(mart, min_orders=min_orders)
        .filter(F.col("region").isNotNull())
        .groupBy("region")
        .agg(
            _sellers(),
            F.sum("total_revenue").alias("total_revenue"),
            average("unique_customer_states", "avg_states_reached"),
            average("same_state_order_rate", "avg_same_state_rate"),
        )
        .transform(ordered, F.desc("total_revenue"), "region")
    )


def geographic_focus(mart: DataFrame, min_orders: int = 1) -> DataFrame:
    return (
        _chosen(mart, min_orders=min_orders)
        .filter(F.col("geographic_focus").isNotNull())
        .groupBy("geographic_focus")
        .agg(
            _sellers(),
            average("total_revenue", "avg_revenue"),
            average("same_state_order_rate", "avg_same_state_rate"),
            average("unique_customer_states", "avg_states_reached"),
        )
        .transform(ordered, F.desc("avg_revenue"), "geographic_focus")
    )


def delivery_and_review(mart: DataFrame, **chosen) -> DataFrame:
    known = F.col("on_time_delivery_rate").isNotNull() & F.col("avg_review_score").isNotNull()
    return _chosen(mart, **chosen).filter(known).select(
        "seller_id",
        "on_time_delivery_rate",
        "avg_review_score",
        "total_revenue",
        "total_orders",
        "seller_health",
        "positive_review_rate",
    )
