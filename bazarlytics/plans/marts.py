"""The four business marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazarlytics.functions import values as v
from bazarlytics.functions.columns import (
    any_bit,
    any_true,
    bits,
    case,
    count_where,
    date_key,
    day_gap,
    month_start,
    percent,
    ratio,
    surrogate_key,
    tier,
    zero,
)
from bazarlytics.operators.grouping import (
    dealt,
    dealt_by,
    has_hot_key,
    most_frequent,
    value_profile,
)
from bazarlytics.operators.ordering import with_ntiles, with_percent_rank
from bazarlytics.plans.dimensions import day_literal, review_profile
from bazarlytics.session import freeze


def _sum_and_count(**columns: str | Column) -> list[Column]:
    """Partial averages: a total and the number of known values for each column."""
    parts = []
    for name, value in columns.items():
        value = F.col(value) if isinstance(value, str) else value
        parts += [F.sum(value).alias(f"{name}_sum"), F.count(value).alias(f"{name}_n")]
    return parts


def _mean_of(name: str) -> Column:
    return ratio(F.sum(f"{name}_sum"), F.sum(f"{name}_n"))


def customer_orders(orders: DataFrame, today: Column) -> DataFrame:
    """Order history per customer, through (customer, order) subtotals.

    Averages and totals weigh an order by its rows in ``fct_orders`` (one per review);
    counts take each order once.
    """
    rows = dealt_by(
        orders, "customer_id", "order_id", has_hot_key(orders, "customer_id"),
        "order_purchase_timestamp", "total_order_value", "item_count", "total_freight",
        "max_installments", "days_to_delivery", "review_score", "is_delivered", "is_canceled",
        "used_installments", "delivery_performance", "days_vs_estimated", "has_comment",
    )
    per_order = rows.groupBy("customer_id", "order_id").agg(
        F.min("order_purchase_timestamp").alias("first"),
        F.max("order_purchase_timestamp").alias("last"),
        *_sum_and_count(
            value="total_order_value",
            items="item_count",
            freight="total_freight",
            parts="max_installments",
            days="days_to_delivery",
            score="review_score",
        ),
        any_true(F.col("is_delivered")).alias("delivered"),
        any_true(F.col("is_canceled")).alias("canceled"),
        any_true(F.col("used_installments")).alias("in_parts"),
        any_true(F.col("delivery_performance") == "on_time").alias("on_time"),
        any_true(F.col("days_vs_estimated") <= 0).alias("kept"),
        any_true(F.col("has_comment")).alias("commented"),
    )
    summary = per_order.groupBy("customer_id").agg(
        F.min("first").alias("first_order_date"),
        F.max("last").alias("last_order_date"),
        F.count("order_id").alias("orders"),
        F.sum("value_sum").alias("revenue"),
        _mean_of("value").alias("avg_order_value"),
        F.sum("items_sum").alias("items"),
        _mean_of("items").alias("avg_items_per_order"),
        F.sum("freight_sum").alias("freight"),
        _mean_of("freight").alias("avg_freight_per_order"),
        _mean_of("parts").alias("avg_max_installments"),
        _mean_of("days").alias("avg_delivery_days"),
        _mean_of("score").alias("avg_review_score"),
        *[
            count_where(F.col(c)).alias(c)
            for c in ("delivered", "canceled", "in_parts", "on_time", "kept", "commented")
        ],
    )
    span = day_gap("first_order_date", "last_order_date")
    return summary.withColumns(
        {
            "recency_days": day_gap("last_order_date", today),
            "avg_days_between_orders": ratio(span, F.col("orders") - 1),
        }
    )


def customer_tastes(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct products and categories per customer and the favourite category.

    A line counts once per row of its order in ``fct_orders``, so reviews weigh in. A
    product has one category, which lets the product count add up over categories.
    """
    rows = dealt(orders, ["order_id"], "customer_id")
    copies = rows.groupBy("order_id", "customer_id").agg(F.count("*").alias("copies"))
    category = "product_category_name_english"
    lines = items.filter(F.col(category).isNotNull()).select("order_id", "product_id", category)
    bought = dealt_by(
        lines.join(copies, "order_id"), "customer_id", "product_id",
        has_hot_key(orders, "customer_id"), category, "copies",
    )
    per_product = bought.groupBy("customer_id", category, "product_id").agg(
        F.sum("copies").alias("n")
    )
    per_category = per_product.groupBy("customer_id", category).agg(
        F.sum("n").alias("n"), F.count("product_id").alias("products")
    )
    return per_category.groupBy("customer_id").agg(
        F.sum("products").alias("unique_products_purchased"),
        F.count(category).alias("unique_categories_purchased"),
        most_frequent(category, "n").alias("favorite_category"),
    )


def rfm_segment(r: str, f: str, m: str) -> Column:
    r, f, m = F.col(r), F.col(f), F.col(m)
    champions, loyal, new, at_risk, lost, big, regular = v.RFM_SEGMENTS
    return case(
        [
            (F.least(r, f, m) >= 4, champions),
            (F.least(r, f, m) >= 3, loyal),
            ((r >= 4) & (f <= 2), new),
            ((r <= 2) & (f >= 3), at_risk),
            ((r <= 2) & (f <= 2), lost),
            (m >= 4, big),
        ],
        regular,
    )


def lifecycle_stage(orders: str, recency: str) -> Column:
    orders, recency = F.col(orders), F.col(recency)
    repeat, new, cooling, at_risk, dormant, never = v.LIFECYCLE_STAGES
    return case(
        [
            (orders == 0, never),
            ((recency <= 90) & (orders >= 3), repeat),
            (recency <= 90, new),
            (recency <= 180, cooling),
            (recency <= 365, at_risk),
        ],
        dormant,
    )


def mart_customer_analytics(
    customers: DataFrame,
    orders: DataFrame,
    items: DataFrame,
    geography: DataFrame,
    as_of: str | Column | None = None,
) -> DataFrame:
    """Customer value, RFM quintiles and life cycle.

    Quintile ties are broken by customer id. The history is frozen once, as the three
    score orders and the final join all read it.
    """
    known = customers.select("customer_id")
    history = freeze(
        customer_orders(orders, day_literal(as_of, orders)).join(known, "customer_id", "left_semi")
    )
    scored = with_ntiles(
        history, {"r_rank": "recency_days", "f_score": "orders", "m_score": "revenue"}, "customer_id"
    ).withColumn("r_score", 6 - F.col("r_rank"))
    places = geography.select("zip_code_prefix", "region", "city_size_tier")
    base = customers.select(
        "customer_key", "customer_id", "customer_unique_id", "customer_zip_code_prefix",
        "customer_city", "customer_state", "customer_state_clean", "customer_segment",
        "days_since_last_order",
    )
    joined = (
        base.join(scored, "customer_id", "left")
        .join(customer_tastes(orders, items), "customer_id", "left")
        .join(places, F.col("customer_zip_code_prefix") == F.col("zip_code_prefix"), "left")
        .withColumn("known_orders", zero("orders"))
    )
    scores = [zero(c) for c in ("r_score", "f_score", "m_score")]
    return joined.select(
        "customer_key",
        "customer_id",
        "customer_unique_id",
        "customer_zip_code_prefix",
        "customer_city",
        "customer_state",
        "customer_state_clean",
        "region",
        "city_size_tier",
        "customer_segment",
        "days_since_last_order",
        F.col("known_orders").alias("total_orders"),
        zero("delivered").alias("delivered_orders"),
        zero("canceled").alias("canceled_orders"),
        "first_order_date",
        "last_order_date",
        zero("revenue").alias("lifetime_value"),
        "avg_order_value",
        zero("items").alias("total_items"),
        "avg_items_per_order",
        zero("freight").alias("total_freight"),
        "avg_freight_per_order",
        "recency_days",
        F.col("known_orders").alias("frequency"),
        F.col("revenue").alias("monetary_value"),
        *[
            s.alias(n)
            for s, n in zip(scores, ("recency_score", "frequency_score", "monetary_score"))
        ],
        (scores[0] + scores[1] + scores[2]).alias("rfm_total_score"),
        rfm_segment("r_score", "f_score", "m_score").alias("rfm_segment"),
        "avg_days_between_orders",
        zero("in_parts").alias("installment_orders"),
        "avg_max_installments",
        "avg_delivery_days",
        zero("on_time").alias("on_time_deliveries"),
        percent("on_time", "delivered").alias("on_time_delivery_rate"),
        zero("kept").alias("on_or_before_estimate"),
        "avg_review_score",
        zero("commented").alias("orders_with_comments"),
        zero("unique_products_purchased").alias("unique_products_purchased"),
        zero("unique_categories_purchased").alias("unique_categories_purchased"),
        "favorite_category",
        tier("revenue", v.CUSTOMER_VALUE_TIER).alias("value_tier"),
        lifecycle_stage("known_orders", "recency_days").alias("lifecycle_stage"),
    )


def _daily_orders(
    orders: DataFrame, items: DataFrame, payments: DataFrame, reviews: DataFrame, fanout_safe: bool
) -> DataFrame:
    """Sums and flags per day, from one row per order.

    Joining lines, primary payments and reviews to an order repeats it
    ``lines * payments * reviews`` times. Rather than building those rows, each side is
    counted per order and the order's measures are weighted by the product. With
    ``fanout_safe`` every order and every review counts once.
    """
    measures = ("value", "freight", "paid", "items", "days")
    day = date_key("order_purchase_timestamp").alias("date_key")
    delivered = F.col("is_delivered")
    # by order, as the joins below need it
    rows = dealt(
        orders, ["order_id"], "customer_id", "order_purchase_timestamp", "total_order_value",
        "total_freight", "total_payment_value", "item_count", "days_to_delivery", "is_delivered",
        "is_canceled", "delivery_performance", "days_vs_estimated",
    )
    per_order = rows.groupBy(day, "order_id", "customer_id").agg(
        F.count("*").alias("copies"),
        *_sum_and_count(
            value="total_order_value",
            freight="total_freight",
            paid="total_payment_value",
            items="item_count",
            days=F.when(delivered, F.col("days_to_delivery")),
        ),
        any_true(delivered).alias("delivered"),
        any_true(F.col("is_canceled")).alias("canceled"),
        any_true(delivered & (F.col("delivery_performance") == "on_time")).alias("on_time"),
        any_true(delivered & (F.col("days_vs_estimated") <= 0)).alias("kept"),
    )
    lines = items.groupBy("order_id").agg(F.count("*").alias("lines"))
    paid = (
        payments.filter("is_primary_payment")
        .groupBy("order_id")
        .agg(
            F.count("*").alias("payments"),
            any_true(F.col("is_credit_card")).alias("by_card"),
            any_true(F.col("is_boleto")).alias("by_boleto"),
            any_true(F.col("uses_installments")).alias("in_parts"),
        )
    )
    rated = reviews.groupBy("order_id").agg(
        F.count("*").alias("reviews"), *_sum_and_count(score="review_score")
    )
    wide = (
        per_order.join(lines, "order_id", "left")
        .join(paid, "order_id", "left")
        .join(rated, "order_id", "left")
    )
    at_least_one = {c: F.greatest(zero(c), F.lit(1)) for c in ("lines", "payments", "reviews")}
    if fanout_safe:
        order_weight = ratio(F.lit(1), F.col("copies"))
        review_weight = F.lit(1)
    else:
        order_weight = at_least_one["lines"] * at_least_one["payments"] * at_least_one["reviews"]
        review_weight = F.col("copies") * at_least_one["lines"] * at_least_one["payments"]
    weighted = [
        F.sum(F.col(f"{m}_{part}") * order_weight).alias(f"{m}_{part}")
        for m in measures
        for part in ("sum", "n")
    ]
    return wide.groupBy("date_key").agg(
        F.count("*").alias("total_orders"),
        *[
            count_where(F.col(c)).alias(c)
            for c in ("delivered", "canceled", "on_time", "kept", "by_card", "by_boleto", "in_parts")
        ],
        *weighted,
        F.sum(F.col("score_sum") * review_weight).alias("score_sum"),
        F.sum(F.col("score_n") * review_weight).alias("score_n"),
    )


def mart_executive_dashboard(
    orders: DataFrame,
    items: DataFrame,
    payments: DataFrame,
    reviews: DataFrame,
    dates: DataFrame,
    fanout_safe: bool = False,
) -> DataFrame:
    """Daily business metrics with moving averages and year-to-date totals.

    The windows run over one row per calendar day, which bounds their single partition.
    """
    daily = _daily_orders(orders, items, payments, reviews, fanout_safe)
    # by itself, since beside the sums every customer of a day would carry all of them
    day = date_key("order_purchase_timestamp").alias("date_key")
    buyers = _distinct_per_day(orders.select(day, "customer_id"), "customer_id", "unique_customers")
    sold = items.withColumnRenamed("order_date_key", "date_key")
    supply = _distinct_per_day(sold, "seller_id", "unique_sellers").join(
        _distinct_per_day(sold, "product_id", "unique_products"), "date_key", "full"
    )
    voices = (
        reviews.groupBy(F.col("order_date_key").alias("date_key"), "review_id")
        .agg(
            any_true(F.col("is_positive")).alias("positive"),
            any_true(F.col("is_negative")).alias("negative"),
        )
        .groupBy("date_key")
        .agg(
            F.count("review_id").alias("total_reviews"),
            count_where(F.col("positive")).alias("positive"),
            count_where(F.col("negative")).alias("negative"),
        )
    )
    calendar = dates.select(
        "date_key", "date_day", "year", "quarter", "month_name", "year_month", "day_name",
        "is_weekend", "is_holiday", "holiday_name",
    )
    joined = (
        calendar.join(daily, "date_key", "left")
        .join(buyers, "date_key", "left")
        .join(supply, "date_key", "left")
        .join(voices, "date_key", "left")
    )
    day = joined.select(
        *calendar.columns[1:],
        zero("total_orders").alias("total_orders"),
        zero("delivered").alias("delivered_orders"),
        zero("canceled").alias("canceled_orders"),
        F.col("value_sum").cast("double").alias("total_revenue"),
        F.col("freight_sum").cast("double").alias("total_freight"),
        F.col("paid_sum").cast("double").alias("total_payments"),
        ratio("value_sum", "value_n").alias("avg_order_value"),
        zero("unique_customers").alias("unique_customers"),
        F.col("items_sum").cast("long").alias("total_items"),
        ratio("items_sum", "items_n").alias("avg_items_per_order"),
        zero("total_reviews").alias("total_reviews"),
        ratio("score_sum", "score_n").alias("avg_review_score"),
        zero("positive").alias("positive_reviews"),
        zero("negative").alias("negative_reviews"),
        zero("by_card").alias("credit_card_orders"),
        zero("by_boleto").alias("boleto_orders"),
        zero("in_parts").alias("installment_orders"),
        ratio("days_sum", "days_n").alias("avg_delivery_days"),
        zero("on_time").alias("on_time_deliveries"),
        zero("kept").alias("on_or_before_estimate"),
        zero("unique_sellers").alias("unique_sellers"),
        zero("unique_products").alias("unique_products"),
    )
    by_day = Window.orderBy("date_day")
    week, month = by_day.rowsBetween(-6, 0), by_day.rowsBetween(-29, 0)
    so_far = Window.partitionBy("year").orderBy("date_day")
    return day.select(
        "*",
        percent("delivered_orders", "total_orders").alias("delivery_rate"),
        percent("canceled_orders", "total_orders").alias("cancellation_rate"),
        percent("positive_reviews", "total_reviews").alias("positive_review_rate"),
        percent("on_time_deliveries", "delivered_orders").alias("on_time_delivery_rate"),
        percent("installment_orders", "total_orders").alias("installment_usage_rate"),
        ratio("total_revenue", "unique_customers").alias("revenue_per_customer"),
        F.avg("total_orders").over(week).alias("ma7_orders"),
        F.avg("total_revenue").over(week).alias("ma7_revenue"),
        F.avg("avg_review_score").over(week).alias("ma7_review_score"),
        F.avg("total_orders").over(month).alias("ma30_orders"),
        F.avg("total_revenue").over(month).alias("ma30_revenue"),
        F.sum("total_revenue").over(so_far).alias("ytd_revenue"),
        F.sum("total_orders").over(so_far).alias("ytd_orders"),
    )


def order_subtotals(items: DataFrame, key: str, hot: bool = True) -> DataFrame:
    """(key, order) subtotals of ``fct_order_items``: sums, extremes, per-order flags and the
    order's place. All of them merge, so a stored table answers every measure of the key
    without another look at the lines. What a single line, or one purchase moment, tells already is
    null; unfolded() puts it back. Without a hot key the rows of a key are in one task."""
    price, freight = F.col("item_price"), F.col("freight_value")
    several, bought = F.count("*") > 1, F.col("order_purchase_timestamp")
    flags = {
        "delivered": "is_delivered",
        "canceled": "is_canceled",
        "on_time": "is_on_time_delivery",
        "same_state": "is_same_state",
        "same_city": "is_same_city",
    }
    narrow = items.withColumns(
        {
            "days": F.when(F.col("is_delivered"), F.col("days_to_deliver")),
            "flags": bits(F.col(c) for c in flags.values()),
        }
    )
    lines = dealt_by(
        narrow, key, "order_id", hot, "item_price", "freight_value", "days", "flags",
        "order_purchase_timestamp", "customer_state", "customer_zip_code_prefix",
    )
    return lines.groupBy(key, "order_id").agg(
        F.count("*").alias("lines"),
        *_sum_and_count(price=price, freight=freight, days="days"),
        F.when(several, F.sum(_share())).alias("share_sum"),
        F.count(_share()).alias("share_n"),
        F.when(several, F.sum(price * price)).alias("price_squares"),
        F.min(price).alias("min_price"),
        F.nullif(F.max(price), F.min(price)).alias("max_price"),
        F.nullif(F.min(bought), F.max(bought)).alias("bought"),
        F.max(bought).alias("bought_last"),
        F.min("customer_state").alias("customer_state"),
        F.min("customer_zip_code_prefix").alias("customer_zip_code_prefix"),
        *any_bit("flags", flags),
    )


def _share(freight: str = "freight_value", price: str = "item_price") -> Column:
    return percent(freight, price)


def unfolded(baskets: DataFrame) -> DataFrame:
    """order_subtotals() with every measure of every order."""
    single = F.col("lines") == 1
    squares, price = baskets.schema["price_squares"].dataType, F.col("price_sum").cast("decimal(10,2)")
    return baskets.withColumns(
        {
            "share_sum": F.when(single, _share("freight_sum", "price_sum")).otherwise(F.col("share_sum")),
            "price_squares": F.when(single, (price * price).cast(squares)).otherwise(F.col("price_squares")),
            "max_price": F.coalesce("max_price", "min_price"),
            "bought": F.coalesce("bought", "bought_last"),
        }
    )


def _basket_totals(baskets: DataFrame, key: str, *more: Column) -> DataFrame:
    return baskets.groupBy(key).agg(
        F.count("order_id").alias("orders"),
        F.sum("lines").alias("sold"),
        F.sum("price_sum").alias("revenue"),
        _mean_of("price").alias("avg_price"),
        F.min("min_price").alias("min_price"),
        F.max("max_price").alias("max_price"),
        F.sum("freight_sum").alias("freight"),
        _mean_of("freight").alias("avg_freight"),
        _mean_of("share").alias("avg_freight_percentage"),
        F.min("bought").alias("first_sale_date"),
        F.max("bought_last").alias("last_sale_date"),
        _mean_of("days").alias("avg_delivery_days"),
        *[
            count_where(F.col(c)).alias(c)
            for c in ("delivered", "canceled", "on_time", "same_state", "same_city")
        ],
        *more,
    )


def _reach(baskets: DataFrame, key: str) -> DataFrame:
    """Customer states and zip prefixes a key sells to, and its most frequent state by lines."""
    spots = baskets.groupBy(key, "customer_state", "customer_zip_code_prefix").agg(
        F.sum("lines").alias("n")
    )
    zips = spots.groupBy(key).agg(
        F.countDistinct("customer_zip_code_prefix").alias("unique_customer_locations")
    )
    states = value_profile(
        spots, [key], "customer_state", "unique_customer_states", "top_customer_state", weight="n"
    )
    return zips.join(states, key)


def mart_product_performance(
    products: DataFrame,
    categories: DataFrame,
    items: DataFrame,
    reviews: DataFrame,
    baskets: DataFrame | None = None,
) -> DataFrame:
    """Product sales, reach, reviews, vendors and score; ``baskets`` are the stored
    order_subtotals() of the products, without which the lines are read for each use."""
    hot = has_hot_key(items, "product_id")
    baskets = unfolded(order_subtotals(items, "product_id", hot) if baskets is None else baskets)
    sales = _basket_totals(baskets, "product_id")
    # counted where the lines lie, in buckets of the order as the reviews
    per_order = items.groupBy("product_id", "order_id").agg(F.count("*").alias("lines"))
    rated = review_profile(per_order, "product_id", reviews, whole=not hot)
    sold_by = items if hot else dealt(items, ["product_id"], "seller_id")
    vendors = value_profile(sold_by, ["product_id"], "seller_id", "unique_sellers", "primary_seller_id")
    groups = categories.select(
        "product_category_name",
        "category_group",
        F.col("revenue_tier").alias("category_revenue_tier"),
        "category_size_tier",
    )
    base = products.select(
        "product_id", "product_category_name", "product_category_name_english",
        "category_display_name", "product_weight_g", "product_length_cm", "product_height_cm",
        "product_width_cm", "product_volume_cm3", "product_size_category",
        "product_weight_category", "product_completeness_score", "product_quality_tier",
    )
    joined = (
        base.join(sales, "product_id", "left")
        .join(_reach(baskets, "product_id"), "product_id", "left")
        .join(rated, "product_id", "left")
        .join(vendors, "product_id", "left")
        .join(groups, "product_category_name", "left")
    )
    sold, score = F.col("sold").cast("double"), F.col("avg_review_score")
    return joined.select(
        surrogate_key("product_id").alias("product_key"),
        *base.columns[:4],
        "category_group",
        "category_revenue_tier",
        "category_size_tier",
        *base.columns[4:],
        zero("orders").alias("total_orders"),
        zero("sold").alias("total_units_sold"),
        zero("revenue").alias("total_revenue"),
        "avg_price",
        "min_price",
        "max_price",
        zero("freight").alias("total_freight"),
        "avg_freight",
        "avg_freight_percentage",
        "first_sale_date",
        "last_sale_date",
        day_gap("first_sale_date", "last_sale_date").alias("days_on_sale"),
        zero("delivered").alias("delivered_orders"),
        zero("canceled").alias("canceled_orders"),
        percent("delivered", "orders").alias("delivery_rate"),
        percent("canceled", "orders").alias("cancellation_rate"),
        zero("on_time").alias("on_time_deliveries"),
        percent("on_time", "delivered").alias("on_time_delivery_rate"),
        "avg_delivery_days",
        zero("unique_customer_locations").alias("unique_customer_locations"),
        zero("unique_customer_states").alias("unique_customer_states"),
        "top_customer_state",
        zero("same_state").alias("same_state_sales"),
        zero("same_city").alias("same_city_sales"),
        percent("same_state", "orders").alias("same_state_sales_rate"),
        zero("total_reviews").alias("total_reviews"),
        "avg_review_score",
        *[
            zero(f"{m}_reviews").alias(f"{m}_reviews") for m in ("positive", "neutral", "negative")
        ],
        percent("positive_reviews", "total_reviews").alias("positive_review_rate"),
        zero("reviews_with_comments").alias("reviews_with_comments"),
        "avg_days_to_review",
        zero("unique_sellers").alias("unique_sellers"),
        "primary_seller_id",
        tier("sold", v.MART_SALES_TIER).alias("sales_tier"),
        tier(score, v.MART_REVIEW_TIER).alias("review_tier"),
        F.when(sold > 0, (F.least(sold / 2, F.lit(50.0)) + score * 10) / 10).alias(
            "performance_score"
        ),
        ratio("revenue", "sold").alias("revenue_per_unit"),
    )


def seller_health() -> Column:
    """Health label from review score, on-time rate and sales in the last 90 days."""
    score, kept = F.col("avg_review_score"), F.col("on_time_delivery_rate")
    recent = F.col("last_90") > 0
    excellent, good, average, poor, unknown = v.SELLER_HEALTH_ORDER
    return case(
        [
            ((score >= 4.5) & (kept >= 90) & recent, excellent),
            ((score >= 4.0) & (kept >= 80) & recent, good),
            ((score >= 3.5) & (kept >= 70), average),
            ((score < 3.5) | (kept < 70), poor),
        ],
        unknown,
    )


def _distinct_per_day(sold: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct keys per day, counted in two steps."""
    return sold.groupBy("date_key", key).count().groupBy("date_key").agg(F.count(key).alias(name))


def mart_seller_scorecard(
    sellers: DataFrame, geography: DataFrame, items: DataFrame, baskets: DataFrame | None = None
) -> DataFrame:
    """Seller sales, reach, recent activity, percentile rank and weighted score; ``baskets`` are
    the stored order_subtotals() of the sellers."""
    if baskets is None:
        baskets = order_subtotals(items, "seller_id", has_hot_key(items, "seller_id"))
    baskets = unfolded(baskets)
    newest = items.agg(F.max("order_purchase_timestamp")).scalar()
    baskets = baskets.withColumns(
        {"age": day_gap("bought", newest), "month": month_start("bought")}
    )
    n, total = F.sum("price_n"), F.sum("price_sum").cast("decimal(18,2)")
    # exact until the last step, so that equal prices have no spread
    squares = n.cast("decimal(12,0)") * F.sum("price_squares").cast("decimal(25,4)") - total * total
    spread = F.when(n > 1, F.sqrt(squares.cast("double") / n / (n - 1)))
    sales = _basket_totals(
        baskets,
        "seller_id",
        spread.alias("price_stddev"),
        F.countDistinct("month").alias("active_months"),
        *[count_where(F.col("age") <= d).alias(f"last_{d}") for d in (30, 90, 180)],
    ).select(
        "seller_id",
        F.col("orders").alias("line_orders"),
        F.col("avg_price").alias("avg_product_price"),
        F.col("min_price").alias("min_product_price"),
        F.col("max_price").alias("max_product_price"),
        "price_stddev",
        "avg_freight_percentage",
        "active_months",
        "last_30",
        "last_90",
        "last_180",
        "same_state",
        "same_city",
    )
    category = "product_category_name_english"
    range_ = value_profile(
        items.filter(F.col(category).isNotNull()), ["seller_id"], category, "unique_categories",
        "top_category",
    )
    places = geography.select("zip_code_prefix", "region", "city_size_tier")
    ranked = with_percent_rank(sellers, "total_revenue", "place").withColumn(
        "revenue_percentile", F.col("place") * 100.0
    )
    joined = (
        ranked.join(places, F.col("seller_zip_code_prefix") == F.col("zip_code_prefix"), "left")
        .join(sales, "seller_id", "left")
        .join(_reach(baskets, "seller_id"), "seller_id", "left")
        .join(range_, "seller_id", "left")
        .withColumn("same_state_order_rate", percent("same_state", "line_orders"))
    )
    local = F.col("same_state_order_rate")
    review100 = F.col("avg_review_score") * 20.0
    active30, recent90, cooling180, inactive, never = v.SELLER_ACTIVITY_ORDER
    local_label, regional, national, multi = v.GEOGRAPHIC_FOCUS
    return joined.select(
        surrogate_key("seller_id").alias("seller_key"),
        "seller_id",
        "seller_zip_code_prefix",
        "seller_city",
        "seller_state",
        "seller_state_clean",
        "region",
        "city_size_tier",
        "seller_performance_tier",
        "seller_size_tier",
        "total_orders",
        "total_items_sold",
        "total_revenue",
        "avg_item_price",
        "total_freight",
        "avg_freight",
        "first_sale_date",
        "last_sale_date",
        "days_active",
        zero("active_months").alias("active_months"),
        *[zero(f"last_{d}").alias(f"orders_last_{d}_days") for d in (30, 90, 180)],
        "unique_products_sold",
        zero("unique_categories").alias("unique_categories"),
        "top_category",
        "avg_product_price",
        "min_product_price",
        "max_product_price",
        "price_stddev",
        "avg_freight_percentage",
        zero("unique_customer_locations").alias("unique_customer_locations"),
        zero("unique_customer_states").alias("unique_customer_states"),
        "top_customer_state",
        zero("same_state").alias("same_state_orders"),
        zero("same_city").alias("same_city_orders"),
        local,
        "avg_review_score",
        "positive_reviews",
        "negative_reviews",
        "total_reviews",
        "positive_review_rate",
        "avg_delivery_days",
        "on_time_deliveries",
        "total_delivered_orders",
        "on_time_delivery_rate",
        ratio("total_revenue", "total_items_sold").alias("revenue_per_item"),
        ratio("total_revenue", "total_orders").alias("revenue_per_order"),
        ratio("total_revenue", "days_active").alias("revenue_per_day_active"),
        ratio("total_revenue", "active_months").alias("revenue_per_month"),
        case(
            [
                (F.col("last_30") > 0, active30),
                (F.col("last_90") > 0, recent90),
                (F.col("last_180") > 0, cooling180),
                (F.col("total_orders") > 0, inactive),
            ],
            never,
        ).alias("activity_status"),
        "revenue_percentile",
        review100.alias("review_score_100"),
        F.col("on_time_delivery_rate").alias("delivery_score_100"),
        (
            F.col("revenue_percentile") * 0.4
            + review100 * 0.3
            + F.col("on_time_delivery_rate") * 0.3
        ).alias("overall_performance_score"),
        seller_health().alias("seller_health"),
        tier("unique_categories", v.DIVERSITY_TYPE).alias("product_diversity_type"),
        case(
            [
                (local >= 80, local_label),
                (local >= 50, regional),
                (F.col("unique_customer_states") >= 15, national),
            ],
            multi,
        ).alias("geographic_focus"),
    )
