"""Filters and measures the analyses share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazarlytics.functions.columns import mean, share_where


def in_period(orders: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Orders bought between two days, both included.

    The same bounds on the month let the scan skip whole partitions of ``fct_orders``.
    """
    day, month = F.col("order_date"), F.col("order_month")
    if start is not None:
        orders = orders.filter(
            (day >= F.lit(start).cast("date")) & (month >= F.lit(f"{start[:7]}-01").cast("date"))
        )
    if end is not None:
        last = F.lit(end).cast("date")
        orders = orders.filter((day <= last) & (month <= last))
    return orders


def delivered(orders: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return in_period(orders, start, end).filter("is_delivered")


def where(df: DataFrame, **equals: object) -> DataFrame:
    """Optional equality filters; a value of None filters nothing."""
    for column, value in equals.items():
        if value is not None:
            df = df.filter(F.col(column) == F.lit(value))
    return df


def orders_count(name: str = "total_orders") -> Column:
    return F.count("*").alias(name)


def revenue(name: str = "total_revenue") -> Column:
    return F.sum("total_order_value").alias(name)


def average(value: str, name: str | None = None) -> Column:
    return mean(value).alias(name or f"avg_{value}")


def rate(condition: Column, name: str) -> Column:
    return share_where(condition).alias(name)


def performance(label: str) -> Column:
    return F.col("delivery_performance") == label


def promoters() -> Column:
    return F.col("review_score") >= 4


def detractors() -> Column:
    return F.col("review_score") <= 2
