"""Profile of a built warehouse and summaries of check results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazarlytics.functions.columns import mean, percent, position
from bazarlytics.functions.values import REVIEW_SENTIMENTS
from bazarlytics.operators.grouping import ordered, share_of_total, top, union_all
from bazarlytics.quality.checks import Tables


def table_counts(tables: Tables, names: Sequence[str]) -> DataFrame:
    return union_all(
        [
            tables[n].agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows")
            for n in names
        ],
    )


def coverage(orders: DataFrame) -> DataFrame:
    """Share of orders with a payment, a review and a delivery, and the average order."""
    worth = F.col("total_order_value")
    return orders.agg(
        F.count("*").alias("total_orders"),
        F.count_if(F.col("total_payment_value") > 0).alias("with_payment"),
        F.count("review_score").alias("with_review"),
        F.count_if(F.col("order_status") == "delivered").alias("delivered"),
        mean(F.when(worth > 0, worth)).alias("avg_order_value"),
    ).select(
        "*",
        *[
            percent(c, "total_orders").alias(f"{c}_pct")
            for c in ("with_payment", "with_review", "delivered")
        ],
    )


def label_mix(df: DataFrame, label: str) -> DataFrame:
    """Rows per label with their share, as for order status or customer segment."""
    counted = df.groupBy(label).agg(F.count("*").alias("count"))
    return share_of_total(counted, percentage="count").orderBy(F.desc("count"), label)


def sentiment_mix(orders: DataFrame) -> DataFrame:
    return (
        orders.filter(F.col("review_sentiment").isNotNull())
        .groupBy("review_sentiment")
        .agg(F.count("*").alias("count"), mean("review_score").alias("avg_score"))
        .transform(ordered, position("review_sentiment", REVIEW_SENTIMENTS))
    )


def busiest_states(orders: DataFrame, n: int = 5) -> DataFrame:
    states = (
        orders.filter(F.col("customer_state").isNotNull())
        .groupBy("customer_state")
        .agg(
            F.count("*").alias("orders"),
            F.sum("total_order_value").alias("total_value"),
            mean("total_order_value").alias("avg_value"),
        )
    )
    return top(states, n, F.desc("orders"), "customer_state")


def status_summary(results: DataFrame) -> DataFrame:
    """Check results by status with their share."""
    counted = results.groupBy("status").agg(F.count("*").alias("checks"))
    return share_of_total(counted, percentage="checks").transform(ordered, "status")


def result_totals(results: DataFrame) -> DataFrame:
    passed = F.count_if(F.col("status") == "pass")
    return results.agg(
        F.count("*").alias("checks"),
        passed.alias("passed"),
        F.count_if(F.col("status").isin("fail", "error")).alias("errors"),
        F.count_if(F.col("status") == "warn").alias("warnings"),
        percent(passed, F.count("*")).alias("pass_rate"),
    )


def failing_checks(results: DataFrame) -> DataFrame:
    """Checks that did not pass, most failures first."""
    bad = results.filter(~F.col("status").isin("pass", "success"))
    return bad.transform(ordered, F.desc("failures"), "name")


def slowest_checks(results: DataFrame, n: int = 20) -> DataFrame:
    return top(results.filter(F.col("seconds").isNotNull()), n, F.desc("seconds"), "name")
