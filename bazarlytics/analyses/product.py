"""Product analyses over ``mart_product_performance`` (one row per product)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazarlytics.analyses.common import average, where
from bazarlytics.functions.columns import position, ratio
from bazarlytics.functions.values import MART_SALES_TIER
from bazarlytics.operators.grouping import ordered, top

CATEGORY = "product_category_name_english"


def _chosen(mart: DataFrame, category: str | None, min_sales: int) -> DataFrame:
    sold = mart.filter(F.col("total_units_sold") >= min_sales)
    return where(sold, **{CATEGORY: category})


def _named(mart: DataFrame, category: str | None, min_sales: int) -> DataFrame:
    return _chosen(mart, category, min_sales).filter(F.col(CATEGORY).isNotNull())


def category_list(mart: DataFrame) -> DataFrame:
    known = mart.filter(F.col(CATEGORY).isNotNull())
    return ordered(known.select(CATEGORY).distinct(), CATEGORY)


def product_kpis(mart: DataFrame, category: str | None = None, min_sales: int = 1) -> DataFrame:
    return _chosen(mart, category, min_sales).agg(
        F.count("product_id").alias("total_products"),
        F.sum("total_units_sold").alias("total_units"),
        F.sum("total_revenue").alias("total_revenue"),
        average("avg_review_score", "avg_review_score"),
        average("on_time_delivery_rate", "avg_on_time_rate"),
        F.count(F.when(F.col("total_units_sold") >= min_sales, F.col("product_id"))).alias(
            "active_products"
        ),
    )


def top_products(
    mart: DataFrame, category: str | None = None, min_sales: int = 1, n: int = 20
) -> DataFrame:
    best = top(
        _chosen(mart, category, min_sales), n, F.desc("total_units_sold"), "product_id"
    )
    return best.select(
        F.col(CATEGORY).alias("category"),
        "total_units_sold",
        "total_revenue",
        "avg_price",
        "avg_review_score",
        "total_reviews",
        "on_time_delivery_rate",
        "sales_tier",
        "review_tier",
    )


def top_categories(mart: DataFrame, min_sales: int = 1, n: int = 15) -> DataFrame:
    grouped = (
        _named(mart, None, min_sales)
        .groupBy(F.col(CATEGORY).alias("category"))
        .agg(
            F.count("product_id").alias("product_count"),
            F.sum("total_units_sold").alias("total_units"),
            F.sum("total_revenue").alias("total_revenue"),
            average("avg_price", "avg_price"),
            average("avg_review_score", "avg_review"),
            average("on_time_delivery_rate", "avg_on_time_rate"),
        )
        .withColumn("revenue_per_unit", ratio("total_revenue", "total_units"))
    )
    return top(grouped, n, F.desc("total_revenue"), "category")


def price_and_review(mart: DataFrame, category: str | None = None, min_sales: int = 1) -> DataFrame:
    rated = _chosen(mart, category, min_sales).filter(F.col("avg_review_score").isNotNull())
    return rated.select(
        F.col(CATEGORY).alias("category"),
        "avg_price",
        "avg_review_score",
        "total_units_sold",
        "total_reviews",
        "on_time_delivery_rate",
    )


def sales_tiers(mart: DataFrame, category: str | None = None, min_sales: int = 1) -> DataFrame:
    return (
        _chosen(mart, category, min_sales)
        .groupBy("sales_tier")
        .agg(
            F.count("product_id").alias("product_count"),
            F.sum("total_revenue").alias("tier_revenue"),
            average("avg_review_score", "avg_review"),
        )
        .transform(ordered, position("sales_tier", MART_SALES_TIER.labels))
    )


def review_tiers(mart: DataFrame, category: str | None = None, min_sales: int = 1) -> DataFrame:
    return (
        _chosen(mart, category, min_sales)
        .filter(F.col("review_tier") != "No Reviews")
        .groupBy("review_tier")
        .agg(
            F.count("product_id").alias("product_count"),
            average("total_units_sold", "avg_units_sold"),
            average("avg_review_score", "avg_score"),
        )
        .transform(ordered, F.desc("avg_score"))
    )


def delivery_by_category(mart: DataFrame, min_sales: int = 1, n: int = 15) -> DataFrame:
    grouped = (
        _named(mart, None, min_sales)
        .filter(F.col("on_time_delivery_rate").isNotNull())
        .groupBy(F.col(CATEGORY).alias("category"))
        .agg(
            average("on_time_delivery_rate", "avg_on_time_rate"),
            average("avg_delivery_days", "avg_delivery_days"),
            F.sum("total_units_sold").alias("total_units"),
            average("avg_review_score", "avg_review"),
        )
    )
    return top(grouped, n, F.desc("avg_on_time_rate"), "category")


def geographic_reach(
    mart: DataFrame, category: str | None = None, min_sales: int = 1, n: int = 15
) -> DataFrame:
    grouped = (
        _named(mart, category, min_sales)
        .groupBy(F.col(CATEGORY).alias("category"))
        .agg(
            average("unique_customer_states", "avg_states_reached"),
            average("unique_customer_locations", "avg_locations_reached"),
            F.sum("total_units_sold").alias("total_units"),
            average("same_state_sales_rate", "avg_same_state_rate"),
        )
    )
    return top(grouped, n, F.desc("avg_states_reached"), "category")
