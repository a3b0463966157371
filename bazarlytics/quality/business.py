"""Business rules across tables, each as a frame of failing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazarlytics.functions.columns import case, day_gap, either, lookup
from bazarlytics.operators.grouping import dealt, union_all
from bazarlytics.quality.checks import Check, Tables, aggregate_equals


def _reconcile(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Fact totals against the totals a dimension carries; keys missing on a side pass."""
    told = dimension.select(
        key,
        F.col("total_orders").alias("dim_total_orders"),
        F.col("total_items_sold").alias("dim_total_items"),
        F.round("total_revenue", 2).alias("dim_total_revenue"),
    )
    # by order, as the line fact lies; a key's lines are then added up in every task first
    lines = dealt(facts, ["order_id"], key, "item_price")
    counted = lines.groupBy(key).agg(
        F.countDistinct("order_id").alias("fact_total_orders"),
        F.count("*").alias("fact_total_items"),
        F.round(F.sum("item_price"), 2).alias("fact_total_revenue"),
    )
    orders = F.col("fact_total_orders") != F.col("dim_total_orders")
    items = F.col("fact_total_items") != F.col("dim_total_items")
    money = F.abs(F.col("fact_total_revenue") - F.col("dim_total_revenue")) > 0.01
    issue = case(
        [(orders, "Orders mismatch"), (items, "Items mismatch"), (money, "Revenue mismatch")],
        "Unknown mismatch",
    )
    return (
        counted.join(told, key, "full")
        .filter(orders | items | money)
        .withColumn("issue_type", issue)
    )


def category_metrics(t: Tables) -> DataFrame:
    sold = t["fct_order_items"].filter(F.col("product_category_name").isNotNull())
    return _reconcile(sold, t["dim_category"], "product_category_name")


def seller_metrics(t: Tables) -> DataFrame:
    return _reconcile(t["fct_order_items"], t["dim_sellers"], "seller_id")


def missing_date_keys(t: Tables) -> DataFrame:
    """Date keys of the facts that the calendar does not have, with the table they are in."""
    uses = [
        ("fct_order_items", "order_date_key"),
        ("fct_payments", "order_date_key"),
        ("fct_reviews", "review_date_key"),
        ("fct_reviews", "order_date_key"),
    ]
    keys = union_all(
        [
            t[table].select(F.col(column).alias("date_key"), F.lit(table).alias("source_table"))
            for table, column in uses
        ],
    )
    known = keys.filter(F.col("date_key").isNotNull()).distinct()
    return known.join(t["dim_date"].select("date_key"), "date_key", "left_anti")


def delivery_dates_out_of_order(t: Tables) -> DataFrame:
    bought, approved = F.col("order_purchase_timestamp"), F.col("order_approved_at")
    arrived = F.col("order_delivered_customer_date")
    issues = [
        (approved < bought, "Approved before purchase"),
        (arrived < bought, "Delivered before purchase"),
        (arrived < approved, "Delivered before approval"),
    ]
    done = t["stg_orders"].filter((F.col("order_status") == "delivered") & arrived.isNotNull())
    return (
        done.filter(either(condition for condition, _ in issues))
        .select(
            "order_id", bought, approved, arrived, "order_estimated_delivery_date",
            case(issues, "Other date logic error").alias("issue_type"),
        )
        .distinct()
    )


def geography_without_entities(t: Tables) -> DataFrame:
    buyers, vendors = F.col("customer_count"), F.col("seller_count")
    kind = F.col("location_type")
    bad = (
        ((buyers == 0) & (vendors == 0))
        | (F.col("total_entities") == 0)
        | ((kind == "Customer Only") & (buyers == 0))
        | ((kind == "Seller Only") & (vendors == 0))
        | ((kind == "Both") & ((buyers == 0) | (vendors == 0)))
    )
    return t["dim_geography"].filter(bad).select(
        "zip_code_prefix", "city", "state", buyers, vendors, "total_entities", kind
    )


def negative_values(t: Tables) -> DataFrame:
    watched = [
        ("fct_order_items", "order_id", "item_price"),
        ("fct_order_items", "order_id", "freight_value"),
        ("fct_payments", "order_id", "payment_value"),
        ("dim_sellers", "seller_id", "total_revenue"),
        ("dim_category", "product_category_name", "total_revenue"),
        ("dim_products", "product_id", "total_revenue"),
    ]
    return union_all(
        [
            t[table].filter(F.col(column) < 0).select(
                F.lit(table).alias("table_name"),
                F.col(key).alias("record_id"),
                F.lit(column).alias("column_name"),
                F.col(column).cast("decimal(20,2)").alias("value"),
            )
            for table, key, column in watched
        ],
    )


def items_against_payments(t: Tables, tolerance: float = 0.01) -> DataFrame:
    """Orders on both sides whose line total and payment total differ."""
    lines = t["fct_order_items"].groupBy("order_id").agg(
        F.sum("total_item_value").alias("total_items")
    )
    paid = t["fct_payments"].groupBy("order_id").agg(F.sum("payment_value").alias("total_payments"))
    gap = F.abs(F.col("total_items") - F.col("total_payments"))
    return lines.join(paid, "order_id").withColumn("difference", gap).filter(gap > tolerance)


def product_categories(t: Tables) -> DataFrame:
    """Products whose category differs between lines and dimension or is on one side only."""

    def named(table: str, name: str) -> DataFrame:
        category = F.col("product_category_name")
        known = t[table].filter(category.isNotNull())
        return known.select("product_id", category.alias(name)).distinct()

    both = named("fct_order_items", "fact_category").join(
        named("dim_products", "dim_category"), "product_id", "full"
    )
    return both.filter(~F.col("fact_category").eqNullSafe(F.col("dim_category")))


def reviews_before_purchase(t: Tables) -> DataFrame:
    created, bought = F.col("review_creation_date"), F.col("order_purchase_timestamp")
    return t["fct_reviews"].filter(created < bought).select(
        "review_id", "order_id", created, bought, day_gap(bought, created).alias("days_difference")
    )


def sentiment_mismatch(t: Tables) -> DataFrame:
    score = F.col("review_score")
    expected = case([(score >= 4, "positive"), (score == 3, "neutral")], "negative")
    return (
        t["fct_reviews"]
        .select(
            "review_id", "order_id", score, "review_sentiment",
            expected.alias("expected_sentiment"),
        )
        .filter("review_sentiment != expected_sentiment")
    )


def reviews_of_unfulfilled_orders(t: Tables) -> DataFrame:
    status = F.col("order_status")
    bad = status.isNull() | ~status.isin("delivered", "shipped", "canceled")
    return t["fct_reviews"].filter(bad).select("review_id", "order_id", status)


def _orders(t: Tables, bad: Column, issue: str, *columns: str | Column) -> DataFrame:
    return t["fct_orders"].filter(bad).select("order_id", *columns, F.lit(issue).alias("issue"))


def orders_without_customer(t: Tables) -> DataFrame:
    return _orders(t, F.col("customer_id").isNull(), "Missing customer_id")


def order_payment_mismatch(t: Tables, tolerance: float = 0.5) -> DataFrame:
    worth, paid = F.col("total_order_value"), F.col("total_payment_value")
    gap = F.abs(worth - paid)
    bad = (gap > tolerance) & (worth > 0) & (paid > 0)
    return _orders(t, bad, "Order/Payment mismatch", worth, paid, gap.alias("difference"))


def invalid_scores(t: Tables) -> DataFrame:
    score = F.col("review_score")
    return _orders(t, (score < 1) | (score > 5), "Invalid review score", score)


def orders_without_items(t: Tables) -> DataFrame:
    open_ = ~F.col("order_status").isin("canceled", "unavailable")
    return _orders(t, open_ & (F.col("item_count") == 0), "Order with no items", "item_count")


def performance_mismatch(t: Tables) -> DataFrame:
    label, days = F.col("delivery_performance"), F.col("days_vs_estimated")
    expected = lookup(F.signum(days), {-1.0: "early", 0.0: "on_time", 1.0: "late"})
    return _orders(t, label != expected, "Incorrect delivery performance", label, days)


def executive_revenue(t: Tables, mart: str = "mart_executive_dashboard_fanout_safe") -> DataFrame:
    """The mart's revenue against the line total, on the variant without fan-out."""
    return aggregate_equals(
        t[mart], "sum(total_revenue)", t["fct_order_items"], "sum(total_item_value)", 0.01
    )


_RULES = {
    "category_metrics": ("dim_category", category_metrics),
    "seller_metrics": ("dim_sellers", seller_metrics),
    "missing_date_keys": ("dim_date", missing_date_keys),
    "delivery_dates_out_of_order": ("stg_orders", delivery_dates_out_of_order),
    "geography_without_entities": ("dim_geography", geography_without_entities),
    "negative_values": ("fct_order_items", negative_values),
    "items_against_payments": ("fct_order_items", items_against_payments),
    "product_categories": ("dim_products", product_categories),
    "reviews_before_purchase": ("fct_reviews", reviews_before_purchase),
    "sentiment_mismatch": ("fct_reviews", sentiment_mismatch),
    "reviews_of_unfulfilled_orders": ("fct_reviews", reviews_of_unfulfilled_orders),
    "order_payment_mismatch": ("fct_orders", order_payment_mismatch),
    "invalid_scores": ("fct_orders", invalid_scores),
    "orders_without_items": ("fct_orders", orders_without_items),
    "performance_mismatch": ("fct_orders", performance_mismatch),
    "executive_revenue": ("mart_executive_dashboard", executive_revenue),
}


def business_checks() -> list[Check]:
    tags = ("data_quality", "business_logic", "singular")
    serious = Check(
        "orders_without_customer", "fct_orders", rows=orders_without_customer, severity="error",
        tags=("data_quality", "critical", "singular"),
    )
    return [serious] + [
        Check(name, table, rows=rule, tags=tags) for name, (table, rule) in _RULES.items()
    ]
