"""Column names and types of the raw tables and of the run history."""

from __future__ import annotations

from pyspark.sql import types as T

_MONEY = T.DecimalType(10, 2)
_POINT = T.DecimalType(10, 6)
_TIME = T.TimestampNTZType()
_TEXT = T.StringType()
_INT = T.IntegerType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


RAW = {
    "orders": _table(
        order_id=_TEXT,
        customer_id=_TEXT,
        order_status=_TEXT,
        order_purchase_timestamp=_TIME,
        order_approved_at=_TIME,
        order_delivered_carrier_date=_TIME,
        order_delivered_customer_date=_TIME,
        order_estimated_delivery_date=_TIME,
    ),
    "customers": _table(
        customer_id=_TEXT,
        customer_unique_id=_TEXT,
        customer_zip_code_prefix=_TEXT,
        customer_city=_TEXT,
        customer_state=_TEXT,
    ),
    "order_items": _table(
        order_id=_TEXT,
        order_item_id=_INT,
        product_id=_TEXT,
        seller_id=_TEXT,
        shipping_limit_date=_TIME,
        price=_MONEY,
        freight_value=_MONEY,
    ),
    "payments": _table(
        order_id=_TEXT,
        payment_sequential=_INT,
        payment_type=_TEXT,
        payment_installments=_INT,
        payment_value=_MONEY,
    ),
    "reviews": _table(
        review_id=_TEXT,
        order_id=_TEXT,
        review_score=_INT,
        review_comment_title=_TEXT,
        review_comment_message=_TEXT,
        review_creation_date=_TIME,
        review_answer_timestamp=_TIME,
    ),
    "products": _table(
        product_id=_TEXT,
        product_category_name=_TEXT,
        product_name_lenght=_INT,
        product_description_lenght=_INT,
        product_photos_qty=_INT,
        product_weight_g=_MONEY,
        product_length_cm=_MONEY,
        product_height_cm=_MONEY,
        product_width_cm=_MONEY,
    ),
    "sellers": _table(
        seller_id=_TEXT, seller_zip_code_prefix=_TEXT, seller_city=_TEXT, seller_state=_TEXT
    ),
    "geolocation": _table(
        geolocation_zip_code_prefix=_TEXT,
        geolocation_lat=_POINT,
        geolocation_lng=_POINT,
        geolocation_city=_TEXT,
        geolocation_state=_TEXT,
    ),
    "category_translation": _table(
        product_category_name=_TEXT, product_category_name_english=_TEXT
    ),
}

RUN_HISTORY = _table(
    invocation_id=_TEXT,
    run_started_at=_TIME,
    run_completed_at=_TIME,
    dbt_command=_TEXT,
    success=T.BooleanType(),
    total_models=_INT,
    total_tests=_INT,
    total_runtime_seconds=T.DoubleType(),
    dbt_version=_TEXT,
    target_name=_TEXT,
)

MODEL_HISTORY = _table(
    invocation_id=_TEXT,
    model_name=_TEXT,
    schema_name=_TEXT,
    materialization=_TEXT,
    status=_TEXT,
    execution_time_seconds=T.DoubleType(),
    rows_affected=_INT,
    executed_at=_TIME,
    unique_id=_TEXT,
)

CHECK_RESULTS = _table(
    name=_TEXT, severity=_TEXT, failures=T.LongType(), status=_TEXT, seconds=T.DoubleType()
)
