"""The six dimension tables.

Distinct-order counts are taken at (key, order) grain: the first aggregation spreads a hot
key over its orders, the second adds flags up. That is
exact and avoids copying every row once per distinct expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazarlytics.functions.columns import (
    any_bit,
    any_true,
    bits,
    case,
    count_where,
    date_key,
    day_gap,
    day_of_week,
    flag,
    group_of,
    lookup,
    mean,
    percent,
    ratio,
    surrogate_key,
    tier,
    zero,
)
from bazarlytics.functions import values as v
from bazarlytics.operators.grouping import dealt, dealt_by, has_hot_key


def as_of_day(orders: DataFrame) -> Column:
    """Default reference day: the day of the latest purchase, as a scalar subquery."""
    return orders.agg(F.to_date(F.max("order_purchase_timestamp"))).scalar()


def day_literal(as_of: str | Column | None, orders: DataFrame) -> Column:
    if as_of is None:
        return as_of_day(orders)
    return F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of


def dim_customers(
    customers: DataFrame, order_reviews: DataFrame, as_of: str | Column | None = None
) -> DataFrame:
    """Customers with their order history.

    ``order_reviews`` has one row per order and review, as ``int_orders_enriched`` and
    ``fct_orders`` do. Recency counts from ``as_of``, by default the last purchase day.
    """
    bought, score = F.col("order_purchase_timestamp"), F.col("review_score")
    rows = dealt_by(
        order_reviews, "customer_id", "order_id", has_hot_key(order_reviews, "customer_id"),
        "order_purchase_timestamp", "review_score", "order_status",
    )
    per_order = rows.groupBy("customer_id", "order_id").agg(
        F.min(bought).alias("first"),
        F.max(bought).alias("last"),
        F.sum(score).alias("score"),
        F.count(score).alias("scores"),
        any_true(F.col("order_status") == "delivered").alias("delivered"),
        any_true(F.col("order_status") == "canceled").alias("canceled"),
    )
    history = per_order.groupBy("customer_id").agg(
        F.count("order_id").alias("orders"),
        F.min("first").alias("first_order_date"),
        F.max("last").alias("last_order_date"),
        F.try_divide(F.sum("score").cast("double"), F.sum("scores")).alias("avg_review_score"),
        count_where(F.col("delivered")).alias("delivered"),
        count_where(F.col("canceled")).alias("canceled"),
    )
    today = day_literal(as_of, order_reviews)
    return customers.join(history, "customer_id", "left").select(
        surrogate_key("customer_id").alias("customer_key"),
        *customers.columns,
        zero("orders").alias("lifetime_orders"),
        "first_order_date",
        "last_order_date",
        "avg_review_score",
        zero("delivered").alias("delivered_orders"),
        zero("canceled").alias("canceled_orders"),
        tier("orders", v.CUSTOMER_SEGMENT).alias("customer_segment"),
        day_gap("last_order_date", today).alias("days_since_last_order"),
    )


def dim_products(products: DataFrame, categories: DataFrame, items: DataFrame) -> DataFrame:
    # orders are marked where the lines lie, in buckets of the order, whose id then stays there
    mark = F.row_number().over(Window.partitionBy("order_id", "product_id").orderBy("order_id")) == 1
    marked = items.select(
        "product_id", "order_id", "price", "freight_value",
        (mark & F.col("order_id").isNotNull()).cast("int").alias("order"),
    )
    if has_hot_key(items, "product_id"):
        lines = dealt(marked, ["product_id", "order_id"], "price", "freight_value", "order")
    else:
        known = marked.filter(F.col("product_id").isNotNull())
        lines = dealt(known, ["product_id"], "price", "freight_value", "order")
    sales = lines.groupBy("product_id").agg(
        F.sum("order").alias("orders"),
        F.count("*").alias("sold"),
        F.sum("price").alias("revenue"),
        mean("price").alias("avg_price"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.sum("freight_value").alias("freight"),
        mean("freight_value").alias("avg_freight"),
    )
    joined = products.join(categories, "product_category_name", "left").join(
        sales, "product_id", "left"
    )
    return joined.select(
        "product_id",
        "product_category_name",
        "product_category_name_english",
        "category_display_name",
        *[c for c in products.columns if c not in ("product_id", "product_category_name")],
        tier("product_completeness_score", v.QUALITY_TIER).alias("product_quality_tier"),
        tier("product_volume_cm3", v.VOLUME_TIER).alias("product_size_category"),
        tier("product_weight_g", v.WEIGHT_TIER).alias("product_weight_category"),
        zero("orders").alias("total_orders"),
        zero("sold").alias("total_items_sold"),
        zero("revenue").alias("total_revenue"),
        "avg_price",
        "min_price",
        "max_price",
        zero("freight").alias("total_freight"),
        "avg_freight",
        tier("sold", v.PRODUCT_SALES_TIER).alias("product_performance_tier"),
    )


def seller_baskets(items: DataFrame) -> DataFrame:
    """Mergeable (seller, order) subtotals of the staged lines."""
    price, freight = F.col("price"), F.col("freight_value")
    # by order, as the staged lines lie and as the joins with orders and reviews need it
    lines = dealt(items, ["order_id"], "seller_id", "price", "freight_value")
    return lines.groupBy("seller_id", "order_id").agg(
        F.count("*").alias("lines"),
        F.sum(price).alias("revenue"),
        F.count(price).alias("priced"),
        F.sum(freight).alias("freight"),
        F.count(freight).alias("freighted"),
    )


def dim_sellers(
    sellers: DataFrame,
    items: DataFrame,
    orders: DataFrame,
    reviews: DataFrame,
    baskets: DataFrame | None = None,
) -> DataFrame:
    """Sellers with sales, review and delivery measures, all from one (seller, order) frame;
    ``baskets`` are the stored seller_baskets().

    Review and delivery averages weigh an order by the seller's lines in it. The on-time
    count includes shipped orders while its denominator holds delivered ones only.
    """
    baskets = seller_baskets(items) if baskets is None else baskets
    header = orders.select(
        "order_id",
        "order_status",
        "order_purchase_timestamp",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
    )
    fulfilled = F.col("order_status").isin("delivered", "shipped")
    took = F.when(fulfilled, day_gap("order_purchase_timestamp", "order_delivered_customer_date"))
    kept = F.col("order_delivered_customer_date") <= F.col("order_estimated_delivery_date")
    sales = (
        baskets.join(header, "order_id", "left")
        .withColumn("took", took)
        .groupBy("seller_id")
        .agg(
            F.count("*").alias("orders"),
            F.sum("lines").alias("sold"),
            F.sum("revenue").alias("revenue"),
            ratio(F.sum("revenue"), F.sum("priced")).alias("avg_item_price"),
            F.sum("freight").alias("freight"),
            ratio(F.sum("freight"), F.sum("freighted")).alias("avg_freight"),
            F.min("order_purchase_timestamp").alias("first_sale_date"),
            F.max("order_purchase_timestamp").alias("last_sale_date"),
            ratio(
                F.sum(F.col("took") * F.col("lines")),
                F.sum(F.when(F.col("took").isNotNull(), F.col("lines"))),
            ).alias("avg_delivery_days"),
            count_where(fulfilled & kept).alias("on_time"),
            count_where(F.col("order_status") == "delivered").alias("delivered"),
        )
    )
    range_ = items.groupBy("seller_id").agg(
        F.countDistinct("product_id").alias("unique_products_sold")
    )
    rated = review_profile(baskets, "seller_id", reviews)
    reviewed, revenue = F.col("total_reviews"), F.col("revenue")
    performance = case(
        [
            ((revenue >= low) & (F.col("avg_review_score") >= score), label)
            for low, score, label in v.SELLER_PERFORMANCE_STEPS
        ]
        + [(revenue > 0, v.SELLER_TIER_ORDER[3])],
        v.SELLER_TIER_ORDER[4],
    )
    joined = (
        sellers.join(sales, "seller_id", "left")
        .join(range_, "seller_id", "left")
        .join(rated, "seller_id", "left")
    )
    return joined.select(
        *sellers.columns,
        zero("orders").alias("total_orders"),
        zero("sold").alias("total_items_sold"),
        zero("revenue").alias("total_revenue"),
        "avg_item_price",
        zero("freight").alias("total_freight"),
        "avg_freight",
        "first_sale_date",
        "last_sale_date",
        zero("unique_products_sold").alias("unique_products_sold"),
        "avg_review_score",
        zero("positive_reviews").alias("positive_reviews"),
        zero("negative_reviews").alias("negative_reviews"),
        zero(reviewed).alias("total_reviews"),
        percent("positive_reviews", reviewed).alias("positive_review_rate"),
        "avg_delivery_days",
        zero("on_time").alias("on_time_deliveries"),
        zero("delivered").alias("total_delivered_orders"),
        percent("on_time", "delivered").alias("on_time_delivery_rate"),
        day_gap("first_sale_date", "last_sale_date").alias("days_active"),
        performance.alias("seller_performance_tier"),
        tier("sold", v.SELLER_SIZE_TIER).alias("seller_size_tier"),
    )


def review_profile(
    baskets: DataFrame, key: str, reviews: DataFrame, whole: bool = False
) -> DataFrame:
    """Reviews of a key's orders, where ``baskets`` counts the key's ``lines`` per order.

    With ``whole`` a key's rows meet in one task, which moves them once.

    A review id is counted once per key however many lines or orders it comes with; the
    average score and the average wait weigh each review by the lines it is joined to.
    """
    waits = "days_delivery_to_review"
    wait = (F.col(waits) if waits in reviews.columns else F.lit(None)).cast("long")
    mood = F.col("review_sentiment")
    names = ("positive", "neutral", "negative", "commented")
    flags = bits([*(mood == m for m in names[:3]), F.col("has_comment")])
    slim = reviews.select(
        "order_id", "review_id", "review_score", flags.alias("flags"), wait.alias("wait")
    )
    lines, score = F.col("lines"), F.col("review_score")
    rated = baskets.join(slim, "order_id")
    if whole:
        rated = dealt_by(rated, key, "review_id", False, "lines", *slim.columns[2:])
    per_review = (
        rated.groupBy(key, "review_id")
        .agg(
            F.sum(score * lines).alias("score"),
            F.sum(F.when(score.isNotNull(), lines)).alias("scored"),
            F.sum(F.col("wait") * lines).alias("wait"),
            F.sum(F.when(F.col("wait").isNotNull(), lines)).alias("waited"),
            *any_bit("flags", names),
        )
    )
    return per_review.groupBy(key).agg(
        F.count("review_id").alias("total_reviews"),
        ratio(F.sum("score"), F.sum("scored")).alias("avg_review_score"),
        *[
            count_where(F.col(m)).alias(f"{m}_reviews") for m in ("positive", "neutral", "negative")
        ],
        count_where(F.col("commented")).alias("reviews_with_comments"),
        ratio(F.sum("wait"), F.sum("waited")).alias("avg_days_to_review"),
    )


def dim_category(
    categories: DataFrame, products: DataFrame, items: DataFrame, sold: DataFrame | None = None
) -> DataFrame:
    """Categories with their sales; ``sold`` are the lines with the known category of their product."""
    named = products.filter(F.col("product_category_name").isNotNull()).select(
        "product_id", "product_category_name"
    )
    sizes = named.groupBy("product_category_name").agg(
        F.countDistinct("product_id").alias("products")
    )
    sold = items.join(named, "product_id") if sold is None else sold
    sales = (
        dealt(sold, ["order_id"], "product_category_name", "price", "freight_value")
        .groupBy("product_category_name")
        .agg(
            F.countDistinct("order_id").alias("orders"),
            F.count("*").alias("sold"),
            F.sum("price").alias("revenue"),
            mean("price").alias("avg_item_price"),
            F.min("price").alias("min_item_price"),
            F.max("price").alias("max_item_price"),
            F.sum("freight_value").alias("freight"),
            mean("freight_value").alias("avg_freight"),
        )
    )
    joined = categories.join(sizes, "product_category_name", "left").join(
        sales, "product_category_name", "left"
    )
    return joined.select(
        "product_category_name",
        "product_category_name_english",
        "category_display_name",
        zero("products").alias("total_products"),
        zero("orders").alias("total_orders"),
        zero("sold").alias("total_items_sold"),
        zero("revenue").alias("total_revenue"),
        "avg_item_price",
        "min_item_price",
        "max_item_price",
        zero("freight").alias("total_freight"),
        "avg_freight",
        F.coalesce(ratio(zero("revenue"), "products"), F.lit(0.0)).alias("revenue_per_product"),
        tier("revenue", v.CATEGORY_REVENUE_TIER).alias("revenue_tier"),
        tier("sold", v.CATEGORY_SIZE_TIER).alias("category_size_tier"),
        tier("avg_item_price", v.CATEGORY_PRICE_TIER).alias("price_tier"),
        tier("avg_freight", v.FREIGHT_TIER).alias("freight_tier"),
        group_of("product_category_name_english", v.CATEGORY_GROUPS, v.CATEGORY_GROUP_OTHER).alias(
            "category_group"
        ),
    )


def dim_geography(geolocation: DataFrame, customers: DataFrame, sellers: DataFrame) -> DataFrame:
    """Every zip prefix in use, with place names, coordinates and entity counts."""

    def per_zip(df: DataFrame, who: str) -> DataFrame:
        zip_code = F.col(f"{who}_zip_code_prefix")
        return df.groupBy(zip_code.alias("zip_code_prefix")).agg(
            *[F.min(f"{who}_{c}").alias(c) for c in ("city", "state", "state_clean")],
            F.countDistinct(F.when(zip_code.isNotNull(), F.col(f"{who}_id"))).alias("n"),
        )

    both = (
        per_zip(customers, "customer")
        .withColumns({"buyers": F.col("n"), "vendors": F.lit(0)})
        .unionByName(
            per_zip(sellers, "seller").withColumns({"buyers": F.lit(0), "vendors": F.col("n")})
        )
    )
    places = both.groupBy("zip_code_prefix").agg(
        *[F.min(c).alias(c) for c in ("city", "state", "state_clean")],
        F.sum("buyers").alias("customer_count"),
        F.sum("vendors").alias("seller_count"),
    )
    points = geolocation.select(
        F.col("geolocation_zip_code_prefix").alias("zip_code_prefix"),
        F.col("geolocation_lat").alias("latitude"),
        F.col("geolocation_lng").alias("longitude"),
    )
    buyers, vendors = F.col("customer_count") > 0, F.col("seller_count") > 0
    entities = F.col("customer_count") + F.col("seller_count")
    return places.join(points, "zip_code_prefix", "left").select(
        "zip_code_prefix",
        "city",
        "state",
        "state_clean",
        "latitude",
        "longitude",
        (F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).alias("has_coordinates"),
        "customer_count",
        "seller_count",
        entities.alias("total_entities"),
        case(
            zip((buyers & vendors, buyers, vendors), v.LOCATION_TYPES), v.LOCATION_TYPES[-1]
        ).alias("location_type"),
        group_of("state_clean", v.REGION_STATES, v.REGION_UNKNOWN).alias("region"),
        lookup("state_clean", v.STATE_NAMES, F.col("state")).alias("state_name"),
        tier(entities, v.CITY_SIZE_TIER).alias("city_size_tier"),
    )


def dim_date(orders: DataFrame) -> DataFrame:
    """One row per day between the first and the last purchase."""
    day = F.col("date_day")
    days = orders.agg(
        F.to_date(F.min("order_purchase_timestamp")).alias("lo"),
        F.to_date(F.max("order_purchase_timestamp")).alias("hi"),
    ).select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date_day"))
    year, quarter, month = F.year(day), F.quarter(day), F.month(day)
    first, last = F.dayofmonth(day) == 1, day == F.last_day(day)
    weekday = day_of_week(day)
    holiday = case(
        [((month == m) & (F.dayofmonth(day) == d), name) for m, d, name in v.HOLIDAYS]
    )
    return days.select(
        date_key(day).alias("date_key"),
        day,
        year.alias("year"),
        year.alias("year_number"),
        F.date_format(day, "yyyy").alias("year_name"),
        quarter.alias("quarter"),
        F.concat(F.date_format(day, "yyyy"), F.lit("-Q"), quarter).alias("quarter_name"),
        month.alias("month_number"),
        F.date_format(day, "MMMM").alias("month_name"),
        F.date_format(day, "MMM").alias("month_name_short"),
        F.date_format(day, "yyyy-MM").alias("year_month"),
        F.weekofyear(day).alias("week_of_year"),
        weekday.alias("day_of_week"),
        F.date_format(day, "EEEE").alias("day_name"),
        F.date_format(day, "E").alias("day_name_short"),
        F.dayofmonth(day).alias("day_of_month"),
        F.dayofyear(day).alias("day_of_year"),
        weekday.isin(0, 6).alias("is_weekend"),
        (~weekday.isin(0, 6)).alias("is_weekday"),
        first.alias("is_month_start"),
        last.alias("is_month_end"),
        (first & (month % 3 == 1)).alias("is_quarter_start"),
        (last & (month % 3 == 0)).alias("is_quarter_end"),
        (F.dayofyear(day) == 1).alias("is_year_start"),
        (last & (month == 12)).alias("is_year_end"),
        year.alias("fiscal_year"),
        quarter.alias("fiscal_quarter"),
        holiday.alias("holiday_name"),
        flag(holiday.isNotNull()).alias("is_holiday"),
    )
