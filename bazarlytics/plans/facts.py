"""The four fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazarlytics.functions.columns import (
    case,
    clean_state,
    date_key,
    day_gap,
    flag,
    lookup,
    percent,
    tier,
    zero,
)
from bazarlytics.functions.values import (
    ANSWER_MISSING,
    ANSWER_TIMING,
    COMMENT_DETAIL,
    INSTALLMENT_CATEGORY,
    PAYMENT_VALUE_TIER,
    PRICE_TIER,
    REVIEW_SCORE_CATEGORIES,
    REVIEW_SCORE_UNKNOWN,
    REVIEW_TIMING,
    VOLUME_TIER,
)
from bazarlytics.plans.intermediate import order_totals
from bazarlytics.plans.staging import ORDER_TIMES, order_timing


def _status(name: str) -> Column:
    return flag(F.col("order_status") == name)


_TOTALS = ["item_count", "total_item_price", "total_freight", "total_order_value", "avg_item_price"]
_PAID = [
    "total_payment_value", "payment_method_count", "primary_payment_method", "max_installments",
    "used_credit_card", "used_boleto", "used_voucher", "used_installments",
]


def fct_orders(
    orders_enriched: DataFrame, payments: DataFrame, items: DataFrame, by_month: bool = False
) -> DataFrame:
    """Order metrics; the payment, item and review sides all meet on one exchange by order.

    With ``by_month`` the rows are rebalanced by month for a partitioned write, before the columns
    that follow from an order's own are worked out.
    """
    joined = orders_enriched.join(payments, "order_id", "left").join(
        order_totals(items), "order_id", "left"
    )
    if by_month:
        joined = (
            joined.select(
                "order_id", "customer_id", "order_status", *ORDER_TIMES, "order_month",
                "customer_city", "customer_state", "review_id", "review_score", "review_sentiment",
                "has_comment", *_TOTALS, *_PAID,
            )
            .hint("rebalance", "order_month")
            .withColumns({c: e for c, e in order_timing().items() if c != "order_month"})
            .withColumn("customer_state_clean", clean_state("customer_state"))
        )
    paid, worth = zero("total_payment_value"), zero("total_order_value")
    return joined.select(
        "order_id",
        "customer_id",
        "order_status",
        "order_purchase_timestamp",
        "order_approved_at",
        "order_delivered_carrier_date",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
        "order_date",
        "order_month",
        "order_year",
        "hours_to_approval",
        "days_to_delivery",
        "delivery_performance",
        "days_vs_estimated",
        "customer_city",
        "customer_state",
        "customer_state_clean",
        "review_id",
        "review_score",
        "review_sentiment",
        "has_comment",
        *[
            zero(c).alias(c)
            for c in ("item_count", "total_item_price", "total_freight", "total_order_value")
        ],
        F.coalesce("avg_item_price", F.lit(0.0)).alias("avg_item_price"),
        paid.alias("total_payment_value"),
        "payment_method_count",
        "primary_payment_method",
        "max_installments",
        "used_credit_card",
        "used_boleto",
        "used_voucher",
        "used_installments",
        (paid - worth).alias("payment_order_diff"),
        _status("delivered").alias("is_delivered"),
        _status("canceled").alias("is_canceled"),
        flag(F.col("review_score") >= 4).alias("is_positive_review"),
    )


def fct_order_items(items_enriched: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Order lines. Here ``days_vs_estimated`` is positive for an early delivery.

    ``context`` is joined here, unless the lines come from lines_in_context().
    """
    lines = items_enriched if context is None else items_enriched.join(context, "order_id", "left")
    bought, due = F.col("order_purchase_timestamp"), F.col("order_estimated_delivery_date")
    arrived = F.col("order_delivered_customer_date")
    delivered = F.col("order_status") == "delivered"
    return lines.select(
        "order_id",
        "order_item_id",
        "product_id",
        "seller_id",
        "customer_id",
        date_key(bought).alias("order_date_key"),
        "shipping_limit_date",
        F.col("price").alias("item_price"),
        "freight_value",
        "total_item_value",
        "product_category_name",
        "product_category_name_english",
        "category_display_name",
        "product_weight_g",
        "product_length_cm",
        "product_height_cm",
        "product_width_cm",
        "product_volume_cm3",
        "seller_zip_code_prefix",
        "seller_city",
        "seller_state",
        "seller_state_clean",
        "order_status",
        "order_purchase_timestamp",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
        "customer_zip_code_prefix",
        "customer_city",
        "customer_state",
        percent("freight_value", "price").alias("freight_percentage"),
        tier("price", PRICE_TIER).alias("price_tier"),
        tier("product_volume_cm3", VOLUME_TIER).alias("volume_tier"),
        flag(F.col("customer_state") == F.col("seller_state")).alias("is_same_state"),
        flag(F.col("customer_city") == F.col("seller_city")).alias("is_same_city"),
        _status("delivered").alias("is_delivered"),
        _status("canceled").alias("is_canceled"),
        _status("shipped").alias("is_shipped"),
        F.when(delivered, flag(arrived <= due)).alias("is_on_time_delivery"),
        F.when(delivered, day_gap(bought, arrived)).alias("days_to_deliver"),
        F.when(delivered, day_gap(arrived, due)).alias("days_vs_estimated"),
    )


def fct_payments(payments: DataFrame, context: DataFrame) -> DataFrame:
    value, parts, kind = F.col("payment_value"), F.col("payment_installments"), F.col("payment_type")
    return payments.join(context, "order_id", "left").select(
        "order_id",
        "payment_sequential",
        "customer_id",
        date_key("order_purchase_timestamp").alias("order_date_key"),
        kind,
        "payment_type_display",
        parts,
        value,
        "order_status",
        "order_purchase_timestamp",
        "customer_zip_code_prefix",
        "customer_city",
        "customer_state",
        *[
            flag(kind == t).alias(f"is_{t}")
            for t in ("credit_card", "boleto", "voucher", "debit_card")
        ],
        flag(parts > 1).alias("uses_installments"),
        tier(parts, INSTALLMENT_CATEGORY).alias("installment_category"),
        tier(value, PAYMENT_VALUE_TIER).alias("payment_value_tier"),
        (value.cast("double") / F.when(parts > 0, parts).otherwise(1)).alias("installment_value"),
        flag(F.col("payment_sequential") == 1).alias("is_primary_payment"),
        _status("delivered").alias("is_delivered"),
        _status("canceled").alias("is_canceled"),
    )


def fct_reviews(reviews: DataFrame, context: DataFrame, items: DataFrame) -> DataFrame:
    basket = order_totals(items).select(
        "order_id",
        F.col("total_item_price").alias("order_value"),
        F.col("item_count").alias("order_item_count"),
    )
    created, answered = F.col("review_creation_date"), F.col("review_answer_timestamp")
    arrived, mood = F.col("order_delivered_customer_date"), F.col("review_sentiment")
    waited, message_size = day_gap(arrived, created), F.length("review_comment_message")
    answer_days = day_gap(created, answered)
    return reviews.join(context, "order_id", "left").join(basket, "order_id", "left").select(
        "review_id",
        "order_id",
        "customer_id",
        date_key(created).alias("review_date_key"),
        date_key("order_purchase_timestamp").alias("order_date_key"),
        "review_score",
        "review_comment_title",
        "review_comment_message",
        created,
        answered,
        mood,
        "has_comment",
        "has_answer",
        lookup("review_score", REVIEW_SCORE_CATEGORIES, REVIEW_SCORE_UNKNOWN).alias(
            "review_score_category"
        ),
        *[flag(mood == m).alias(f"is_{m}") for m in ("positive", "neutral", "negative")],
        "order_status",
        "order_purchase_timestamp",
        arrived,
        "customer_zip_code_prefix",
        "customer_city",
        "customer_state",
        zero("order_value").alias("order_value"),
        zero("order_item_count").alias("order_item_count"),
        day_gap("order_purchase_timestamp", created).alias("days_order_to_review"),
        waited.alias("days_delivery_to_review"),
        answer_days.alias("days_to_answer"),
        tier(waited, REVIEW_TIMING).alias("review_timing"),
        F.coalesce(F.length("review_comment_title"), F.lit(0)).alias("title_length"),
        F.coalesce(message_size, F.lit(0)).alias("message_length"),
        tier(message_size, COMMENT_DETAIL).alias("comment_detail_level"),
        case([(answered.isNull(), ANSWER_MISSING)], tier(answer_days, ANSWER_TIMING)).alias(
            "answer_timing"
        ),
        _status("delivered").alias("is_delivered"),
        _status("canceled").alias("is_canceled"),
    )
