"""Raw tables cleaned and typed: one function per table, row-wise except geolocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazarlytics.functions.columns import (
    add_all,
    case,
    clean_state,
    days_between,
    hours_between,
    lookup,
    mean,
    money,
    month_start,
)
from bazarlytics.functions.values import PAYMENT_TYPE_DISPLAY, PAYMENT_TYPE_OTHER
from bazarlytics.operators.grouping import dealt

ORDER_TIMES = [
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
]


def order_timing() -> dict[str, Column]:
    """Calendar columns and delivery timing of an order, from its moments."""
    bought, due = F.col("order_purchase_timestamp"), F.col("order_estimated_delivery_date")
    arrived = F.col("order_delivered_customer_date")
    return {
        "order_date": F.to_date(bought),
        "order_month": month_start(bought),
        "order_year": F.trunc(F.to_date(bought), "year"),
        "hours_to_approval": hours_between(bought, "order_approved_at"),
        "days_to_delivery": days_between(bought, arrived),
        "delivery_performance": case(
            [(arrived < due, "early"), (arrived == due, "on_time"), (arrived > due, "late")]
        ),
        "days_vs_estimated": days_between(due, arrived),
    }


def stg_orders(raw: DataFrame) -> DataFrame:
    """Order header with calendar columns and delivery timing.

    ``days_vs_estimated`` is negative for an early delivery. ``on_time`` means the exact
    promised moment; anything sooner is ``early``. The raw columns are dealt by order, as the table
    is stored, before the others are worked out of them.
    """
    return (
        raw.filter(F.col("order_id").isNotNull())
        .withColumns({c: F.col(c).cast("timestamp_ntz") for c in ORDER_TIMES})
        .transform(dealt, ["order_id"], "customer_id", "order_status", *ORDER_TIMES)
        .withColumns(order_timing())
    )


def stg_order_items(raw: DataFrame) -> DataFrame:
    price, freight = money("price"), money("freight_value")
    return raw.filter(F.col("order_id").isNotNull() & F.col("order_item_id").isNotNull()).select(
        "order_id",
        "order_item_id",
        "product_id",
        "seller_id",
        F.col("shipping_limit_date").cast("timestamp_ntz").alias("shipping_limit_date"),
        price.alias("price"),
        freight.alias("freight_value"),
        (price + freight).alias("total_item_value"),
        price.alias("item_revenue"),
        freight.alias("freight_revenue"),
    )


def stg_payments(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("order_id").isNotNull()).select(
        "order_id",
        "payment_sequential",
        "payment_type",
        F.col("payment_installments").cast("int").alias("payment_installments"),
        money("payment_value").alias("payment_value"),
        lookup("payment_type", PAYMENT_TYPE_DISPLAY, PAYMENT_TYPE_OTHER).alias(
            "payment_type_display"
        ),
    )


def stg_reviews(raw: DataFrame) -> DataFrame:
    score = F.col("review_score").cast("int")
    title, message = F.col("review_comment_title"), F.col("review_comment_message")
    return raw.filter(F.col("review_id").isNotNull()).select(
        "review_id",
        "order_id",
        score.alias("review_score"),
        title,
        message,
        F.col("review_creation_date").cast("timestamp_ntz").alias("review_creation_date"),
        F.col("review_answer_timestamp").cast("timestamp_ntz").alias("review_answer_timestamp"),
        (title.isNotNull() | message.isNotNull()).alias("has_comment"),
        F.col("review_answer_timestamp").isNotNull().alias("has_answer"),
        case([(score > 3, "positive"), (score == 3, "neutral"), (score < 3, "negative")]).alias(
            "review_sentiment"
        ),
    )


def stg_products(raw: DataFrame) -> DataFrame:
    sides = {side: money(f"product_{side}_cm") for side in ("length", "height", "width")}
    present = [
        F.col("product_name_lenght").isNotNull(),
        F.col("product_description_lenght").isNotNull(),
        F.col("product_photos_qty") > 0,
        F.col("product_category_name").isNotNull(),
    ]
    return raw.filter(F.col("product_id").isNotNull()).select(
        "product_id",
        "product_category_name",
        F.col("product_name_lenght").cast("int").alias("product_name_length"),
        F.col("product_description_lenght").cast("int").alias("product_description_length"),
        F.col("product_photos_qty").cast("int").alias("product_photos_qty"),
        money("product_weight_g").alias("product_weight_g"),
        *[value.alias(f"product_{side}_cm") for side, value in sides.items()],
        (sides["length"] * sides["height"] * sides["width"]).alias("product_volume_cm3"),
        add_all(F.when(p, 1).otherwise(0) for p in present).alias("product_completeness_score"),
    )


def stg_customers(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("customer_id").isNotNull()).select(
        "customer_id",
        "customer_unique_id",
        "customer_zip_code_prefix",
        "customer_city",
        "customer_state",
        clean_state("customer_state").alias("customer_state_clean"),
    )


def stg_sellers(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("seller_id").isNotNull()).select(
        "seller_id",
        "seller_zip_code_prefix",
        "seller_city",
        "seller_state",
        clean_state("seller_state").alias("seller_state_clean"),
    )


def stg_geolocation(raw: DataFrame) -> DataFrame:
    """One row per zip prefix: mean coordinates, smallest city and state names."""
    zip_code = "geolocation_zip_code_prefix"
    return (
        raw.filter(F.col(zip_code).isNotNull())
        .groupBy(zip_code)
        .agg(
            mean(F.col("geolocation_lat").cast("decimal(10,6)")).alias("geolocation_lat"),
            mean(F.col("geolocation_lng").cast("decimal(10,6)")).alias("geolocation_lng"),
            F.min("geolocation_city").alias("geolocation_city"),
            F.min("geolocation_state").alias("geolocation_state"),
        )
        .withColumn("geolocation_state_clean", clean_state("geolocation_state"))
    )


def stg_category_translation(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("product_category_name").isNotNull()).select(
        "product_category_name",
        "product_category_name_english",
        F.translate("product_category_name_english", "_", " ").alias("category_display_name"),
    )


MODELS = {
    "stg_orders": (stg_orders, "orders"),
    "stg_order_items": (stg_order_items, "order_items"),
    "stg_payments": (stg_payments, "payments"),
    "stg_reviews": (stg_reviews, "reviews"),
    "stg_products": (stg_products, "products"),
    "stg_customers": (stg_customers, "customers"),
    "stg_sellers": (stg_sellers, "sellers"),
    "stg_geolocation": (stg_geolocation, "geolocation"),
    "stg_category_translation": (stg_category_translation, "category_translation"),
}
