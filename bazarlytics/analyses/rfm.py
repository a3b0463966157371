"""Customer value analyses over ``mart_customer_analytics`` (one row per customer)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazarlytics.analyses.common import average, where
from bazarlytics.functions.columns import position
from bazarlytics.functions.values import LIFECYCLE_STAGES, VALUE_TIER_ORDER
from bazarlytics.operators.grouping import ordered, share_of_total


def _chosen(mart: DataFrame, segment: str | None, lifecycle: str | None) -> DataFrame:
    return where(mart, rfm_segment=segment, lifecycle_stage=lifecycle)


def _people(name: str = "customer_count"):
    return F.count("customer_id").alias(name)


def _ltv(name: str = "total_ltv"):
    return F.sum("lifetime_value").alias(name)


def segment_list(mart: DataFrame) -> DataFrame:
    known = mart.filter(F.col("rfm_segment").isNotNull())
    return known.select("rfm_segment").distinct().transform(ordered, "rfm_segment")


def customer_kpis(
    mart: DataFrame, segment: str | None = None, lifecycle: str | None = None
) -> DataFrame:
    return _chosen(mart, segment, lifecycle).agg(
        _people("total_customers"),
        _ltv(),
        average("lifetime_value", "avg_ltv"),
        average("total_orders", "avg_orders"),
        average("recency_days", "avg_recency"),
        average("avg_review_score", "avg_satisfaction"),
    )


def segment_summary(mart: DataFrame) -> DataFrame:
    return (
        mart.filter(F.col("rfm_segment").isNotNull())
        .groupBy("rfm_segment")
        .agg(
            _people(),
            _ltv(),
            average("lifetime_value", "avg_ltv"),
            average("total_orders", "avg_orders"),
            average("recency_days", "avg_recency"),
            average("rfm_total_score", "avg_rfm_score"),
            average("avg_review_score", "avg_satisfaction"),
        )
        .transform(ordered, F.desc("avg_rfm_score"), "rfm_segment")
    )


def score_counts(
    mart: DataFrame, segment: str | None = None, lifecycle: str | None = None
) -> DataFrame:
    scores = ["recency_score", "frequency_score", "monetary_score"]
    counted = _chosen(mart, segment, lifecycle).groupBy(*scores).agg(_people())
    return ordered(counted, *scores)


def scores_by_segment(
    mart: DataFrame, segment: str | None = None, lifecycle: str | None = None
) -> DataFrame:
    return (
        _chosen(mart, segment, lifecycle)
        .filter(F.col("rfm_segment").isNotNull())
        .groupBy("rfm_segment")
        .agg(
            average("recency_score", "avg_r"),
            average("frequency_score", "avg_f"),
            average("monetary_score", "avg_m"),
        )
        .transform(ordered, F.desc(F.col("avg_r") + F.col("avg_f") + F.col("avg_m")), "rfm_segment")
    )


def lifecycle_summary(mart: DataFrame) -> DataFrame:
    return (
        mart.groupBy("lifecycle_stage")
        .agg(
            _people(),
            _ltv(),
            average("lifetime_value", "avg_ltv"),
            average("recency_days", "avg_recency"),
            average("total_orders", "avg_orders"),
            average("avg_review_score", "avg_satisfaction"),
        )
        .transform(ordered, position("lifecycle_stage", LIFECYCLE_STAGES))
    )


def value_tier_summary(mart: DataFrame) -> DataFrame:
    return (
        mart.groupBy("value_tier")
        .agg(
            _people(),
            _ltv(),
            average("lifetime_value", "avg_ltv"),
            average("total_orders", "avg_orders"),
            F.min("lifetime_value").alias("min_ltv"),
            F.max("lifetime_value").alias("max_ltv"),
        )
        .transform(ordered, position("value_tier", VALUE_TIER_ORDER))
    )


def segment_characteristics(
    mart: DataFrame, segment: str | None = None, lifecycle: str | None = None
) -> DataFrame:
    grouped = (
        _chosen(mart, segment, lifecycle)
        .filter(F.col("rfm_segment").isNotNull())
        .groupBy("rfm_segment")
        .agg(
            _people("customers"),
            average("recency_days"),
            average("frequency"),
            average("monetary_value", "avg_monetary"),
            average("lifetime_value", "avg_ltv"),
            average("total_orders", "avg_orders"),
            average("avg_order_value", "avg_order_value"),
            average("avg_review_score", "avg_satisfaction"),
            average("on_time_delivery_rate", "avg_on_time_rate"),
            _ltv("ltv"),
        )
    )
    return (
        share_of_total(grouped, ltv_contribution_pct="ltv")
        .drop("ltv")
        .transform(ordered, F.desc("ltv_contribution_pct"), "rfm_segment")
    )


def reactivation_targets(mart: DataFrame) -> DataFrame:
    target = F.col("rfm_segment").isin("At Risk", "Lost") | F.col("lifecycle_stage").isin(
        "Cooling Down", "At Risk", "Dormant"
    )
    return (
        mart.filter(target)
        .groupBy("rfm_segment", "lifecycle_stage")
        .agg(
            _people(),
            _ltv("historical_ltv"),
            average("total_orders", "avg_past_orders"),
            average("recency_days", "avg_days_since_purchase"),
            average("avg_review_score", "avg_past_satisfaction"),
        )
        .transform(ordered, F.desc("historical_ltv"), "rfm_segment", "lifecycle_stage")
    )


def segment_by_region(mart: DataFrame) -> DataFrame:
    return (
        mart.filter(F.col("region").isNotNull() & F.col("rfm_segment").isNotNull())
        .groupBy("region", "rfm_segment")
        .agg(_people(), _ltv())
        .transform(ordered, "region", F.desc("total_ltv"), "rfm_segment")
    )


def behavior_patterns(
    mart: DataFrame, segment: str | None = None, lifecycle: str | None = None
) -> DataFrame:
    """Ratios of averages, not averages of ratios."""
    orders = F.avg("total_orders")
    return (
        _chosen(mart, segment, lifecycle)
        .filter(F.col("rfm_segment").isNotNull())
        .groupBy("rfm_segment")
        .agg(
            average("avg_days_between_orders", "avg_repurchase_cycle"),
            average("avg_items_per_order", "avg_basket_size"),
            (F.try_divide(F.avg("installment_orders"), orders) * 100).alias("installment_rate"),
            (F.try_divide(F.avg("orders_with_comments"), orders) * 100).alias("comment_rate"),
            average("unique_categories_purchased", "avg_categories"),
        )
        .transform(ordered, F.asc_nulls_last("avg_repurchase_cycle"), "rfm_segment")
    )
