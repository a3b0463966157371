"""The documented everyday queries on staging tables and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazarlytics.operators.grouping import ordered, share_of_total, top


def revenue_by_month(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Delivered revenue per month; lines are summed per order before the join."""
    per_order = items.groupBy("order_id").agg(F.sum("total_item_value").alias("value"))
    return (
        orders.filter(F.col("order_status") == "delivered")
        .join(per_order, "order_id")
        .groupBy(F.col("order_month").alias("month"))
        .agg(F.round(F.sum("value"), 2).alias("revenue"))
        .transform(ordered, "month")
    )


def top_sold_categories(items: DataFrame, n: int = 10) -> DataFrame:
    category = "product_category_name_english"
    grouped = (
        items.filter(F.col(category).isNotNull())
        .groupBy(F.col(category).alias("category"))
        .agg(
            F.countDistinct("order_id").alias("orders"),
            F.round(F.sum("item_price"), 2).alias("revenue"),
        )
    )
    return top(grouped, n, F.desc("revenue"), "category")


def score_distribution(reviews: DataFrame) -> DataFrame:
    counted = reviews.groupBy("review_score").agg(F.count("*").alias("count"))
    return share_of_total(counted, percentage="count").transform(ordered, F.desc("review_score"))


def daily_revenue(items: DataFrame, dates: DataFrame) -> DataFrame:
    """Line revenue per calendar day with at least one line."""
    daily = items.groupBy(F.col("order_date_key").alias("date_key")).agg(
        F.sum("total_item_value").alias("revenue")
    )
    return daily.join(dates.select("date_key", "date_day"), "date_key").select(
        "date_day", "revenue"
    ).transform(ordered, "date_day")
