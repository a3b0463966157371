"""The declared checks of the warehouse: keys, references, value lists and bounds per table.

The bounds on row counts and years describe the original data set; pass ``scale`` or other
years for data of another size or time.
"""

from __future__ import annotations

from bazarlytics.functions import values as v
from bazarlytics.quality import checks as c
from bazarlytics.quality.business import business_checks
from bazarlytics.quality.checks import Check

# --- fixed values: declared rules ------------------------------------------------------
NOT_NULL = {
    "raw_orders": "order_id customer_id",
    "raw_order_items": "order_id",
    "raw_payments": "order_id",
    "raw_reviews": "review_id",
    "raw_products": "product_id",
    "stg_orders": "order_id customer_id order_status order_purchase_timestamp",
    "stg_customers": "customer_id",
    "stg_order_items": "order_id order_item_id price total_item_value",
    "stg_payments": "order_id payment_value",
    "stg_reviews": "review_id review_score",
    "stg_products": "product_id",
    "stg_sellers": "seller_id",
    "stg_geolocation": "geolocation_zip_code_prefix",
    "stg_category_translation": "product_category_name",
    "fct_orders": "order_id",
    "fct_order_items": (
        "order_id order_item_id product_id seller_id customer_id order_date_key item_price "
        "freight_value total_item_value order_purchase_timestamp is_same_state is_delivered"
    ),
    "fct_payments": (
        "order_id payment_sequential customer_id order_date_key payment_type "
        "payment_type_display payment_installments payment_value is_credit_card is_boleto "
        "uses_installments installment_value is_primary_payment"
    ),
    "fct_reviews": (
        "review_id order_id customer_id review_date_key order_date_key review_score "
        "review_creation_date review_sentiment has_comment has_answer is_positive is_negative "
        "order_value"
    ),
    "dim_category": (
        "product_category_name product_category_name_english total_products total_orders "
        "total_items_sold total_revenue"
    ),
    "dim_date": (
        "date_key date_day year quarter month_number month_name week_of_year day_of_week "
        "day_name is_weekend is_weekday is_holiday"
    ),
    "dim_geography": (
        "zip_code_prefix city state state_clean customer_count seller_count total_entities"
    ),
    "dim_products": "product_id product_completeness_score total_revenue",
    "dim_sellers": (
        "seller_id seller_zip_code_prefix seller_city seller_state seller_state_clean "
        "total_orders total_items_sold total_revenue"
    ),
    "dim_customers": "customer_key customer_id",
    "mart_customer_analytics": "customer_key",
    "mart_product_performance": "product_key",
    "mart_seller_scorecard": "seller_key",
}
UNIQUE = {
    "raw_orders": ["order_id"],
    "raw_reviews": ["review_id"],
    "raw_products": ["product_id"],
    "stg_orders": ["order_id"],
    "stg_customers": ["customer_id"],
    "stg_reviews": ["review_id"],
    "stg_products": ["product_id"],
    "stg_sellers": ["seller_id"],
    "stg_geolocation": ["geolocation_zip_code_prefix"],
    "stg_category_translation": ["product_category_name"],
    "fct_orders": ["order_id"],
    "fct_order_items": ["order_id order_item_id"],
    "fct_payments": ["order_id payment_sequential"],
    "fct_reviews": ["review_id"],
    "dim_category": ["product_category_name"],
    "dim_date": ["date_key", "date_day"],
    "dim_geography": ["zip_code_prefix"],
    "dim_products": ["product_id"],
    "dim_sellers": ["seller_id"],
    "dim_customers": ["customer_key", "customer_id"],
    "mart_customer_analytics": ["customer_key"],
    "mart_product_performance": ["product_key"],
    "mart_seller_scorecard": ["seller_key"],
}
RELATIONSHIPS = [
    ("stg_orders", "customer_id", "stg_customers", "customer_id"),
    ("stg_order_items", "order_id", "stg_orders", "order_id"),
    ("stg_order_items", "product_id", "stg_products", "product_id"),
    ("stg_order_items", "seller_id", "stg_sellers", "seller_id"),
    ("stg_payments", "order_id", "stg_orders", "order_id"),
    ("stg_reviews", "order_id", "stg_orders", "order_id"),
    ("fct_order_items", "order_id", "stg_orders", "order_id"),
    ("fct_order_items", "product_id", "dim_products", "product_id"),
    ("fct_order_items", "seller_id", "dim_sellers", "seller_id"),
    ("fct_order_items", "order_date_key", "dim_date", "date_key"),
    ("fct_payments", "order_id", "stg_orders", "order_id"),
    ("fct_payments", "order_date_key", "dim_date", "date_key"),
    ("fct_reviews", "order_id", "stg_orders", "order_id"),
    ("fct_reviews", "review_date_key", "dim_date", "date_key"),
    ("fct_reviews", "order_date_key", "dim_date", "date_key"),
]
ACCEPTED_VALUES = [
    ("stg_orders", "order_status", v.ORDER_STATUSES),
    ("stg_reviews", "review_score", v.REVIEW_SCORES),
    ("fct_order_items", "order_status", v.ORDER_STATUSES),
    ("fct_order_items", "price_tier", v.PRICE_TIER.labels),
    ("fct_order_items", "volume_tier", [*v.VOLUME_TIER.labels, "Unknown"]),
    ("fct_payments", "payment_type", v.PAYMENT_TYPES),
    ("fct_payments", "order_status", v.ORDER_STATUSES),
    ("fct_payments", "installment_category", v.INSTALLMENT_CATEGORY.labels),
    ("fct_payments", "payment_value_tier", v.PAYMENT_VALUE_TIER.labels),
    ("fct_reviews", "review_score", v.REVIEW_SCORES),
    ("fct_reviews", "review_sentiment", v.REVIEW_SENTIMENTS),
    (
        "fct_reviews",
        "review_score_category",
        [*v.REVIEW_SCORE_CATEGORIES.values(), v.REVIEW_SCORE_UNKNOWN],
    ),
    ("fct_reviews", "review_timing", [*v.REVIEW_TIMING.labels, "Unknown"]),
    ("fct_reviews", "comment_detail_level", [*v.COMMENT_DETAIL.labels, "No Comment"]),
    ("fct_reviews", "answer_timing", [v.ANSWER_MISSING, *v.ANSWER_TIMING.labels]),
    ("dim_category", "revenue_tier", v.CATEGORY_REVENUE_TIER.labels),
    ("dim_category", "category_size_tier", v.CATEGORY_SIZE_TIER.labels),
    ("dim_category", "price_tier", [*v.CATEGORY_PRICE_TIER.labels, "Unknown"]),
    ("dim_category", "category_group", [*v.CATEGORY_GROUPS, v.CATEGORY_GROUP_OTHER]),
    ("dim_geography", "location_type", v.LOCATION_TYPES),
    ("dim_geography", "region", [*v.REGION_STATES, v.REGION_UNKNOWN]),
    ("dim_geography", "city_size_tier", v.CITY_SIZE_TIER.labels),
    ("dim_products", "product_quality_tier", v.QUALITY_TIER.labels),
    ("dim_products", "product_size_category", [*v.VOLUME_TIER.labels, "Unknown"]),
    ("dim_products", "product_weight_category", [*v.WEIGHT_TIER.labels, "Unknown"]),
    ("dim_products", "product_performance_tier", v.PRODUCT_SALES_TIER.labels),
    ("dim_sellers", "seller_performance_tier", v.SELLER_TIER_ORDER),
    ("dim_sellers", "seller_size_tier", v.SELLER_SIZE_TIER.labels),
]
ACCEPTED_RANGES = [
    ("fct_order_items", "order_item_id", 1, None),
    ("fct_order_items", "item_price", 0, None),
    ("fct_order_items", "freight_value", 0, None),
    ("fct_order_items", "total_item_value", 0, None),
    ("fct_order_items", "freight_percentage", 0, 1000),
    ("fct_order_items", "days_to_deliver", 0, 365),
    ("fct_payments", "payment_sequential", 1, None),
    ("fct_payments", "payment_installments", 0, 24),
    ("fct_payments", "payment_value", 0, None),
    ("fct_payments", "installment_value", 0, None),
    ("fct_reviews", "order_value", 0, None),
    ("fct_reviews", "days_order_to_review", 0, 365),
    ("fct_reviews", "days_delivery_to_review", -30, 365),
    ("fct_reviews", "days_to_answer", 0, 365),
    ("dim_category", "total_products", 0, None),
    ("dim_category", "total_orders", 0, None),
    ("dim_category", "total_items_sold", 0, None),
    ("dim_category", "total_revenue", 0, None),
    ("dim_category", "avg_item_price", 0, None),
    ("dim_date", "year", 2016, 2019),
    ("dim_date", "quarter", 1, 4),
    ("dim_date", "month_number", 1, 12),
    ("dim_date", "week_of_year", 1, 53),
    ("dim_date", "day_of_week", 0, 6),
    ("dim_geography", "latitude", -34, 6),
    ("dim_geography", "longitude", -74, -34),
    ("dim_geography", "customer_count", 0, None),
    ("dim_geography", "seller_count", 0, None),
    ("dim_geography", "total_entities", 0, None),
    ("dim_products", "product_weight_g", 0, None),
    ("dim_products", "product_volume_cm3", 0, None),
    ("dim_products", "product_completeness_score", 0, 5),
    ("dim_products", "total_revenue", 0, None),
    ("dim_sellers", "total_orders", 0, None),
    ("dim_sellers", "total_items_sold", 0, None),
    ("dim_sellers", "total_revenue", 0, None),
    ("dim_sellers", "avg_review_score", 1, 5),
    ("dim_sellers", "positive_review_rate", 0, 100),
    ("dim_sellers", "on_time_delivery_rate", 0, 100),
]
# (table, column, low, high, row condition)
VALUES_BETWEEN = [
    ("stg_order_items", "order_item_id", 1, 50, None),
    ("stg_order_items", "price", 0, 10000, None),
    ("stg_order_items", "freight_value", 0, 500, "freight_value is not null"),
    ("stg_order_items", "total_item_value", 0, 10500, None),
    ("stg_payments", "payment_value", 0, 15000, None),
    ("stg_reviews", "review_score", 1, 5, None),
    ("stg_geolocation", "geolocation_lat", -35, 10, "geolocation_lat is not null"),
    ("stg_geolocation", "geolocation_lng", -75, -30, "geolocation_lng is not null"),
]
PURCHASE_YEARS = ("2016-01-01", "2019-12-31")
VALUES_IN_SET = [
    ("stg_orders", "delivery_performance", v.DELIVERY_PERFORMANCES),
    ("stg_payments", "payment_type", v.PAYMENT_TYPES),
    ("stg_reviews", "review_sentiment", v.REVIEW_SENTIMENTS),
]
ROW_COUNTS = {
    "stg_orders": (1000, 200000),
    "stg_order_items": (1000, 300000),
    "stg_payments": (1000, 300000),
    "stg_reviews": (1000, 200000),
    "stg_geolocation": (1000, 50000),
    "fct_order_items": (50000, 300000),
    "fct_payments": (50000, 300000),
    "fct_reviews": (50000, 200000),
    "dim_category": (50, 200),
    "dim_date": (1000, 2000),
    "dim_products": (10000, 50000),
    "mart_executive_dashboard": (1, 50),
    "mart_customer_analytics": (50000, 150000),
    "mart_product_performance": (10000, 50000),
    "mart_seller_scorecard": (2000, 10000),
}
AT_LEAST_ONE = {
    "raw_customers": "customer_id",
    "raw_order_items": "order_id",
    "raw_payments": "order_id",
    "raw_reviews": "review_id",
    "raw_products": "product_id",
    "raw_sellers": "seller_id",
    "raw_geolocation": "geolocation_zip_code_prefix",
    "raw_category_translation": "product_category_name",
}
EXPRESSIONS = [
    ("fct_order_items", "total_value", "total_item_value = item_price + freight_value"),
    (
        "fct_payments",
        "installment_value",
        "abs(installment_value - if(payment_installments > 0, "
        "payment_value / payment_installments, payment_value)) < 0.0001",
    ),
    ("dim_date", "date_key_format", "date_key = year * 10000 + month_number * 100 + day_of_month"),
    ("mart_executive_dashboard", "revenue_not_negative", "total_revenue >= 0"),
]
TEXT_COLUMNS = [
    ("stg_orders", "order_id"), ("stg_orders", "customer_id"), ("stg_reviews", "review_id"),
]
# (source, column, days until a warning, days until an error)
FRESHNESS = [
    ("orders", "order_purchase_timestamp", 365, 730),
    ("order_items", "shipping_limit_date", 365, 730),
    ("reviews", "review_creation_date", 365, 730),
]
CATEGORY_COLUMNS = [
    "product_category_name", "product_category_name_english", "category_display_name",
    "total_products", "total_orders", "total_items_sold", "total_revenue", "avg_item_price",
    "min_item_price", "max_item_price", "total_freight", "avg_freight", "revenue_per_product",
    "revenue_tier", "category_size_tier", "price_tier", "freight_tier", "category_group",
]
LAYER_TAGS = {
    "raw": ("source",),
    "stg": ("staging",),
    "dim": ("dimension", "core"),
    "fct": ("fact", "core"),
    "mart": ("mart",),
}
# named groups of checks by tag; "generic" marks the declared rules of this module
SELECTORS = {
    "critical_tests": ("generic", "staging", "core"),
    "data_quality": ("data_quality",),
    "staging_tests": ("staging",),
    "core_tests": ("core",),
    "mart_tests": ("mart",),
    "dimension_tests": ("dimension",),
    "fact_tests": ("fact",),
    "business_logic_tests": ("business_logic",),
    "smoke_tests": ("generic", "staging"),
    "full_suite": ("generic", "singular"),
}


def _tags(table: str) -> tuple[str, ...]:
    return ("generic", *LAYER_TAGS[table.split("_")[0]])


def declared_checks(
    as_of: str | None = None,
    years: tuple[str, str] = PURCHASE_YEARS,
    scale: float = 1.0,
) -> list[Check]:
    """All declared rules; ``scale`` multiplies the upper bounds of the row counts."""
    out: list[Check] = []

    def add(make, table, *args, **options):
        out.append(make(table, *args, tags=_tags(table), **options))

    for table, columns in NOT_NULL.items():
        for column in columns.split():
            add(c.not_null, table, column)
    for table, keys in UNIQUE.items():
        for key in keys:
            add(c.unique, table, *key.split())
    for rule in RELATIONSHIPS:
        add(c.relationships, *rule)
    for rule in ACCEPTED_VALUES:
        add(c.accepted_values, *rule)
    for rule in ACCEPTED_RANGES:
        add(c.accepted_range, *rule)
    for table, column, low, high, where in VALUES_BETWEEN:
        add(c.values_between, table, column, low, high, where=where)
    add(
        c.values_between, "stg_orders", "order_purchase_timestamp", *years,
        where="order_purchase_timestamp is not null",
    )
    for table, column, allowed in VALUES_IN_SET:
        add(c.values_in_set, table, column, allowed, where=f"{column} is not null")
    for table, (low, high) in ROW_COUNTS.items():
        add(c.row_count_between, table, low, int(high * scale))
    for table, column in AT_LEAST_ONE.items():
        add(c.at_least_one, table, column)
    for rule in EXPRESSIONS:
        add(c.expression_is_true, *rule)
    for table, column in TEXT_COLUMNS:
        add(c.column_type, table, column, "string")
    add(c.column_order, "dim_category", CATEGORY_COLUMNS)
    add(c.pair_ordered, "fct_reviews", "review_date_key", "order_date_key")
    add(c.recency, "raw_orders", "order_purchase_timestamp", 730, as_of)
    return out


def history_checks() -> list[Check]:
    """Rules of the run-history tables."""
    tags = ("generic", "monitoring")
    return [
        c.expression_is_true("run_history", "models_not_negative", "total_models >= 0", tags=tags),
        c.expression_is_true(
            "model_history", "time_not_negative", "execution_time_seconds >= 0", tags=tags
        ),
    ]


def all_checks(as_of: str | None = None) -> list[Check]:
    return declared_checks(as_of) + business_checks()
