"""Retention, cohorts and churn over ``fct_orders``."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazarlytics.analyses.common import average, delivered
from bazarlytics.analyses.revenue import per_customer
from bazarlytics.functions.columns import (
    case,
    count_where,
    day_gap,
    mean,
    month_gap,
    position,
    ratio,
    share_where,
    tier,
)
from bazarlytics.functions.values import ORDER_COUNT_RETENTION, SECOND_PURCHASE_BINS
from bazarlytics.operators.grouping import ordered, share_of_total


def retention_kpis(
    orders: DataFrame,
    start: str | None = None,
    end: str | None = None,
    customer_key: str = "customer_id",
) -> DataFrame:
    repeat = F.col("order_count") >= 2
    return per_customer(orders, start, end, customer_key).agg(
        F.count(customer_key).alias("total_customers"),
        count_where(F.col("order_count") == 1).alias("one_time_customers"),
        count_where(repeat).alias("repeat_customers"),
        share_where(repeat).alias("repeat_rate"),
        average("order_count", "avg_orders_per_customer"),
        mean(F.when(repeat, F.col("tenure"))).alias("avg_customer_lifetime_days"),
    )


def order_count_segments(
    orders: DataFrame,
    start: str | None = None,
    end: str | None = None,
    customer_key: str = "customer_id",
) -> DataFrame:
    segments = (
        per_customer(orders, start, end, customer_key)
        .groupBy(tier("order_count", ORDER_COUNT_RETENTION).alias("customer_segment"))
        .agg(
            F.count("*").alias("customer_count"),
            F.sum("lifetime_value").alias("total_revenue"),
            average("lifetime_value", "avg_ltv"),
            average("aov", "avg_aov"),
        )
    )
    shares = share_of_total(segments, customer_pct="customer_count", revenue_pct="total_revenue")
    return shares.transform(ordered, position("customer_segment", ORDER_COUNT_RETENTION.labels))


def days_to_second_purchase(
    orders: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Days between the first two delivered orders, one row per customer with two.

    Orders are counted per customer and day first. What the window then sorts for one
    customer is bounded by the days of the calendar, however many orders that customer has.
    """
    daily = orders.filter("is_delivered").groupBy("customer_id", "order_date").agg(
        F.count("*").alias("n")
    )
    by_day = Window.partitionBy("customer_id").orderBy("order_date")
    following = F.lead("order_date").over(by_day)
    firsts = daily.select(
        F.col("order_date").alias("first"),
        F.when(F.col("n") > 1, F.col("order_date")).otherwise(following).alias("second"),
        F.row_number().over(by_day).alias("place"),
        "customer_id",
    ).filter("place = 1 AND second IS NOT NULL")
    if start is not None:
        firsts = firsts.filter(F.col("first") >= F.lit(start).cast("date"))
    if end is not None:
        firsts = firsts.filter(F.col("second") <= F.lit(end).cast("date"))
    return firsts.select("customer_id", day_gap("first", "second").alias("days_to_second_purchase"))


def _gap_counts(orders: DataFrame, start: str | None, end: str | None) -> DataFrame:
    gaps = days_to_second_purchase(orders, start, end)
    return gaps.groupBy("days_to_second_purchase").agg(F.count("*").alias("customers"))


def second_purchase_summary(
    orders: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Mean and exact median gap; the gaps are distinct day counts with frequencies."""
    gaps = _gap_counts(orders, start, end)
    days, n = F.col("days_to_second_purchase"), F.col("customers")
    return gaps.agg(
        F.sum(n).alias("customers"),
        ratio(F.sum(days * n), F.sum(n)).alias("avg_days"),
        F.percentile(days, 0.5, n).alias("median_days"),
    )


def second_purchase_bins(
    orders: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Right-closed bins; a gap of zero days lies in none of them and is left out."""
    days = F.col("days_to_second_purchase")
    bins = case(
        [
            ((days > low) & (days <= high) if high is not None else days > low, label)
            for low, high, label in SECOND_PURCHASE_BINS
        ]
    )
    labels = [label for _, _, label in SECOND_PURCHASE_BINS]
    return (
        _gap_counts(orders, start, end)
        .groupBy(bins.alias("days_bucket"))
        .agg(F.sum("customers").alias("customer_count"))
        .filter(F.col("days_bucket").isNotNull())
        .transform(ordered, position("days_bucket", labels))
    )


def cohort_activity(
    orders: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Active customers by cohort month and months since the first order.

    One row per customer and month makes the cohort a window over a customer's months,
    so the orders are read once and never joined to themselves.
    """
    counted = F.lit(True)
    if start is not None:
        counted = counted & (F.col("order_date") >= F.lit(start).cast("date"))
    if end is not None:
        counted = counted & (F.col("order_date") <= F.lit(end).cast("date"))
    months = (
        orders.filter("is_delivered")
        .groupBy("customer_id", "order_month")
        .agg(F.bool_or(counted).alias("counted"))
        .withColumn(
            "cohort_month", F.min("order_month").over(Window.partitionBy("customer_id"))
        )
        .filter("counted")
    )
    if start is not None:
        months = months.filter(F.col("cohort_month") >= F.lit(start).cast("date"))
    return (
        months.groupBy(
            "cohort_month", month_gap("cohort_month", "order_month").alias("months_since_first")
        )
        .agg(F.count("customer_id").alias("active_customers"))
        .transform(ordered, "cohort_month", "months_since_first")
    )


def cohort_retention(
    orders: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Long retention matrix: every cohort by every observed month offset, gaps as zero.

    Percentages are relative to the cohort's month 0, NULL where that month is empty.
    The offsets are collected per cohort into arrays bounded by the calendar's months.
    """
    activity = cohort_activity(orders, start, end)
    offsets = F.array_sort(F.collect_set("months_since_first").over(Window.partitionBy(F.lit(0))))
    counts = F.map_from_entries(
        F.collect_list(F.struct("months_since_first", "active_customers"))
    )
    cohorts = (
        activity.withColumn("offsets", offsets)
        .groupBy("cohort_month")
        .agg(F.first("offsets").alias("offsets"), counts.alias("counts"))
    )
    active = F.coalesce(F.col("counts")[F.col("months_since_first")], F.lit(0))
    return (
        cohorts.withColumn("months_since_first", F.explode("offsets"))
        .select(
            "cohort_month",
            "months_since_first",
            active.alias("active_customers"),
            ratio(active, F.col("counts")[F.lit(0)], 100).alias("retention_pct"),
        )
        .transform(ordered, "cohort_month", "months_since_first")
    )


def cohort_matrix(orders: DataFrame, start: str, end: str) -> DataFrame:
    """Wide retention matrix with a column month_0, month_1, ... for every month offset that
    the period allows; an offset that no cohort reaches is zero for all."""
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    months = max(0, 12 * (last.year - first.year) + last.month - first.month) + 1
    wide = (
        cohort_activity(orders, start, end)
        .groupBy("cohort_month")
        .pivot("months_since_first", list(range(months)))
        .agg(F.sum("active_customers"))
        .na.fill(0)
    )
    return wide.select(
        "cohort_month",
        *[ratio(F.col(f"`{m}`"), F.col("`0`"), 100).alias(f"month_{m}") for m in range(months)],
    ).transform(ordered, "cohort_month")


def retention_curve(
    orders: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    return (
        cohort_retention(orders, start, end)
        .groupBy("months_since_first")
        .agg(F.avg("retention_pct").alias("avg_retention_pct"))
        .transform(ordered, "months_since_first")
    )


def monthly_churn(orders: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Relative fall of the active count; it is negative when the count grows."""
    by_month = Window.orderBy("month")
    now, before = F.col("active_customers"), F.col("prev_active_customers")
    return (
        delivered(orders, start, end)
        .groupBy(F.col("order_month").alias("month"))
        .agg(F.countDistinct("customer_id").alias("active_customers"))
        .withColumn("prev_active_customers", F.lag("active_customers").over(by_month))
        .filter(before.isNotNull())
        .withColumn("churn_rate", ratio(before - now, before, 100))
        .withColumn("net_active_change_pct", -F.col("churn_rate"))
        .transform(ordered, "month")
    )


def review_writers(
    orders: DataFrame,
    start: str | None = None,
    end: str | None = None,
    customer_key: str = "customer_id",
) -> DataFrame:
    per_order = (
        delivered(orders, start, end)
        .groupBy(customer_key, "order_id")
        .agg(
            F.count("*").alias("n"),
            F.sum("total_order_value").alias("value"),
            F.count("review_score").alias("reviews"),
            F.min("order_date").alias("first"),
            F.max("order_date").alias("last"),
        )
    )
    customers = per_order.groupBy(customer_key).agg(
        F.count("order_id").alias("orders"),
        F.sum("value").alias("ltv"),
        ratio(F.sum("value"), F.sum("n")).alias("aov"),
        F.sum("reviews").alias("reviews"),
        day_gap(F.min("first"), F.max("last")).alias("lifetime"),
    )
    kind = F.when(F.col("reviews") > 0, "Review Writers").otherwise("Non-Review Writers")
    return customers.groupBy(kind.alias("customer_type")).agg(
        F.count("*").alias("customer_count"),
        average("orders"),
        average("ltv"),
        average("aov"),
        share_where(F.col("orders") >= 2).alias("repeat_rate"),
        average("lifetime", "avg_lifetime_days"),
    )
