"""Joined and aggregated building blocks; lazy frames, never stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazarlytics.functions.columns import any_true, clean_state, mean, sum_where
from bazarlytics.functions.values import PAYMENT_TYPES
from bazarlytics.operators.grouping import dealt, most_frequent


def int_orders_enriched(
    orders: DataFrame, customers: DataFrame, reviews: DataFrame, dedup_reviews: bool = False
) -> DataFrame:
    """Orders with their customer and reviews.

    An order with several reviews yields several rows. ``dedup_reviews`` keeps only the
    latest review of each order instead.
    """
    return _with_reviews(orders.join(customers, "customer_id", "left"), reviews, dedup_reviews)


def _with_reviews(orders: DataFrame, reviews: DataFrame, dedup_reviews: bool) -> DataFrame:
    review = reviews.select(
        "order_id", "review_id", "review_score", "review_sentiment", "has_comment",
        "review_creation_date",
    )
    if dedup_reviews:
        latest = F.max_by(
            F.struct(*[c for c in review.columns if c != "order_id"]),
            F.struct("review_creation_date", "review_id"),
        )
        review = review.groupBy("order_id").agg(latest.alias("r")).select("order_id", "r.*")
    return orders.join(review, "order_id", "left")


def int_order_items_enriched(
    items: DataFrame, products: DataFrame, sellers: DataFrame, categories: DataFrame
) -> DataFrame:
    """Order lines with product, translated category and seller columns."""
    catalogue = products.join(categories, "product_category_name", "left")
    return items.join(catalogue, "product_id", "left").join(sellers, "seller_id", "left")


def lines_in_context(
    items: DataFrame,
    products: DataFrame,
    sellers: DataFrame,
    categories: DataFrame,
    context: DataFrame,
    carried: DataFrame | None = None,
) -> DataFrame:
    """The rows of int_order_items_enriched() with their order_context(); ``carried`` are the
    order_products(), with which the lines need not move to the products.

    The context comes before the small tables, and what can be worked out of a line's or a
    product's own columns is left out until then, so that the lines move with few columns.
    """
    sides = [F.col(f"product_{side}_cm") for side in ("length", "height", "width")]
    narrow = items.drop("total_item_value")
    if carried is None:
        lines = narrow.join(products.drop("product_volume_cm3"), "product_id", "left")
    else:
        lines = narrow.join(carried, ["order_id", "product_id"], "left")
    lines = (
        lines.join(context, "order_id", "left")
        .withColumns(
            {
                "total_item_value": F.col("price") + F.col("freight_value"),
                "product_volume_cm3": sides[0] * sides[1] * sides[2],
            }
        )
    )
    return lines.join(categories, "product_category_name", "left").join(sellers, "seller_id", "left")


def int_order_payments_aggregated(payments: DataFrame) -> DataFrame:
    """Payments per order, through (order, type) subtotals.

    The subtotals give the number of types and the most used type (smallest name on a tie)
    without holding an order's payments in memory. Both steps, and a join by order, share one
    exchange.
    """
    payments = dealt(
        payments, ["order_id"], "payment_type", "payment_value", "payment_installments"
    )
    value, parts = F.col("payment_value"), F.col("payment_installments")
    by_type = payments.groupBy("order_id", "payment_type").agg(
        F.count("*").alias("n"),
        F.sum(value).alias("value"),
        F.max(parts).alias("most_parts"),
        F.sum(parts).alias("parts"),
        F.count(parts).alias("with_parts"),
        any_true(parts > 1).alias("split"),
    )
    kind = F.col("payment_type")
    spent = {t: sum_where(kind == t, "value") for t in PAYMENT_TYPES[:4]}
    used = {t: any_true(kind == t) for t in PAYMENT_TYPES[:3]}
    return by_type.groupBy("order_id").agg(
        F.sum("value").alias("total_payment_value"),
        F.sum("n").alias("payment_method_count"),
        F.count(kind).alias("unique_payment_types"),
        most_frequent(kind, "n").alias("primary_payment_method"),
        F.max("most_parts").alias("max_installments"),
        F.try_divide(F.sum("parts").cast("double"), F.sum("with_parts")).alias("avg_installments"),
        *[total.alias(f"{t}_value") for t, total in spent.items()],
        *[seen.alias(f"used_{t}") for t, seen in used.items()],
        any_true(F.col("split")).alias("used_installments"),
    )


def brought(df: DataFrame, at: str, key: str, table: DataFrame) -> DataFrame:
    """(at, key) pairs of a frame with the table's columns, for a join on both.

    Only the pairs move to the table and back, once each, and the frame stays dealt by ``at``.
    """
    return df.select(at, key).dropna().distinct().join(table, key)


def order_places(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """The customer's place for every order, with one row per order and customer."""
    place = customers.select(
        "customer_id", "customer_zip_code_prefix", "customer_city", "customer_state"
    )
    return brought(orders, "order_id", "customer_id", place)


def orders_at_places(orders: DataFrame, places: DataFrame, reviews: DataFrame, dedup_reviews: bool = False) -> DataFrame:
    """The rows of int_orders_enriched() from order_places(), but for the customer's person."""
    placed = orders.join(places, ["order_id", "customer_id"], "left").withColumn(
        "customer_state_clean", clean_state("customer_state")
    )
    return _with_reviews(placed, reviews, dedup_reviews)


def order_context(orders: DataFrame, places: DataFrame) -> DataFrame:
    """Order and customer columns that every line-level fact carries, one row per order;
    ``places`` are the order_places()."""
    return orders.select(
        "order_id",
        "customer_id",
        "order_status",
        "order_purchase_timestamp",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
    ).join(places, ["order_id", "customer_id"], "left")


def order_products(items: DataFrame, products: DataFrame) -> DataFrame:
    """The product columns that a line carries, with one row per order and product."""
    return brought(
        items, "order_id", "product_id",
        products.select(
            "product_id", "product_category_name", "product_weight_g", "product_length_cm",
            "product_height_cm", "product_width_cm",
        ),
    )


def order_totals(items: DataFrame) -> DataFrame:
    return items.groupBy("order_id").agg(
        F.count("*").alias("item_count"),
        F.sum("price").alias("total_item_price"),
        F.sum("freight_value").alias("total_freight"),
        F.sum("total_item_value").alias("total_order_value"),
        mean("price").alias("avg_item_price"),
    )
