"""Market analyses by state and city over ``fct_orders``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazarlytics.analyses.common import average, delivered, orders_count, revenue
from bazarlytics.functions.columns import mean, ratio
from bazarlytics.operators.grouping import ordered, share_of_total, top


def state_revenue(orders: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Revenue, freight share and unit economics per state."""
    states = (
        delivered(orders, start, end)
        .filter(F.col("customer_state").isNotNull())
        .groupBy("customer_state")
        .agg(
            F.countDistinct("customer_id").alias("unique_customers"),
            orders_count(),
            revenue(),
            average("total_order_value", "avg_order_value"),
            average("total_freight", "avg_freight"),
            mean(ratio("total_freight", "total_order_value", 100)).alias("freight_pct"),
            average("review_score", "avg_satisfaction"),
            average("days_to_delivery", "avg_delivery_days"),
        )
    )
    return (
        share_of_total(states, revenue_pct="total_revenue", orders_pct="total_orders")
        .withColumn("revenue_per_customer", ratio("total_revenue", "unique_customers"))
        .withColumn("orders_per_customer", ratio("total_orders", "unique_customers"))
        .transform(ordered, F.desc("total_revenue"), "customer_state")
    )


def top_states(
    orders: DataFrame,
    by: str = "total_revenue",
    n: int = 15,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    return top(state_revenue(orders, start, end), n, F.desc(by), "customer_state")


def top_cities(
    orders: DataFrame,
    start: str | None = None,
    end: str | None = None,
    min_orders: int = 50,
    n: int = 20,
) -> DataFrame:
    cities = (
        delivered(orders, start, end)
        .filter(F.col("customer_city").isNotNull())
        .groupBy("customer_city", "customer_state")
        .agg(
            F.countDistinct("customer_id").alias("unique_customers"),
            orders_count(),
            revenue(),
            average("total_order_value", "avg_order_value"),
            average("review_score", "avg_satisfaction"),
        )
        .filter(F.col("total_orders") >= min_orders)
        .withColumn(
            "city_state", F.concat("customer_city", F.lit(" ("), "customer_state", F.lit(")"))
        )
    )
    return top(cities, n, F.desc("total_revenue"), "customer_city", "customer_state")


def state_growth(orders: DataFrame, start: str, end: str) -> DataFrame:
    """Second period against the first twelve months from ``start``, per state."""
    early = F.col("order_date") < F.add_months(F.lit(start).cast("date"), 12)

    def growth(first: str, second: str) -> Column:
        a, b = F.col(first).cast("double"), F.col(second).cast("double")
        return F.when(a > 0, (b - a) / a * 100)

    value = F.col("total_order_value")
    return (
        delivered(orders, start, end)
        .filter(F.col("customer_state").isNotNull())
        .groupBy("customer_state")
        .agg(
            F.sum(F.when(early, value)).alias("first_year_revenue"),
            F.sum(F.when(~early, value)).alias("second_year_revenue"),
            F.count(F.when(early, 1)).alias("first_orders"),
            F.count(F.when(~early, 1)).alias("second_orders"),
        )
        .filter(
            F.col("first_year_revenue").isNotNull() & F.col("second_year_revenue").isNotNull()
        )
        .select(
            "customer_state",
            "first_year_revenue",
            "second_year_revenue",
            growth("first_year_revenue", "second_year_revenue").alias("revenue_growth_pct"),
            growth("first_orders", "second_orders").alias("orders_growth_pct"),
        )
        .transform(ordered, F.desc_nulls_last("revenue_growth_pct"), "customer_state")
    )


def fastest_growing_states(orders: DataFrame, start: str, end: str, n: int = 15) -> DataFrame:
    growth = state_growth(orders, start, end)
    return top(growth, n, F.desc_nulls_last("revenue_growth_pct"), "customer_state")
