"""SQL for the raw tables and every warehouse model, as named common table expressions.

The models are restated on purpose without the rewrites the Spark code makes: real
fan-out joins, plain DISTINCT aggregates and ordinary windows.
"""

from __future__ import annotations

import re

from bazarlytics.functions import values as v
from bazarlytics.sources.retail import CATEGORY_ENGLISH, NATION_STATES
from oracle.sql import day, ladder, mapping, membership, moment, num, pct, per, quote

_STATE = "[" + ", ".join(quote(s) for s in NATION_STATES) + "]"


def _place(nation: str, key: str, zips: int, who: str) -> str:
    return (
        f"CAST(10000 + {nation} * 100 + {key} % {zips} AS VARCHAR) AS {who}_zip_code_prefix, "
        f"'city_' || {nation} || '_' || ({key} % 5) AS {who}_city, "
        f"{_STATE}[{nation} + 1] AS {who}_state"
    )


RAW = {
    "base": f"""
        SELECT o_orderkey AS k, o_custkey, o_orderpriority,
               o_orderdate + to_seconds(o_orderkey * 37 % 86400) AS bought,
               o_orderdate + to_days(CAST(20 + o_orderkey % 10 AS INTEGER)) AS due,
               {mapping("o_orderkey % 20", {0: "canceled", 1: "shipped", 2: "unavailable", 3: "processing"}, "'delivered'")} AS status
        FROM orders""",
    "raw_orders": """
        SELECT 'o' || k AS order_id, 'c' || o_custkey AS customer_id, status AS order_status,
               bought AS order_purchase_timestamp,
               CASE WHEN k % 97 <> 0 THEN bought + to_hours(k % 48) END AS order_approved_at,
               CASE WHEN status IN ('delivered', 'shipped') THEN bought + to_days(CAST(1 + k % 5 AS INTEGER)) END AS order_delivered_carrier_date,
               CASE WHEN status = 'delivered' AND k % 211 <> 0
                    THEN CASE WHEN k % 101 = 0 THEN due ELSE bought + to_days(CAST(3 + k % 37 AS INTEGER)) END
               END AS order_delivered_customer_date,
               due AS order_estimated_delivery_date
        FROM base""",
    "raw_customers": f"""
        SELECT 'c' || c_custkey AS customer_id, 'u' || (c_custkey - c_custkey % 3) AS customer_unique_id,
               {_place("c_nationkey", "c_custkey", 20, "customer")} FROM customer
        UNION ALL
        SELECT 'cs' || s_suppkey, 'us' || s_suppkey, {_place("s_nationkey", "s_suppkey", 20, "customer")} FROM supplier""",
    "raw_sellers": f"""
        SELECT 's' || s_suppkey AS seller_id, {_place("s_nationkey", "s_suppkey", 30, "seller")} FROM supplier
        UNION ALL
        SELECT 'sn' || n_nationkey, {_place("n_nationkey", "n_nationkey", 30, "seller")} FROM nation""",
    "raw_order_items": """
        SELECT 'o' || l_orderkey AS order_id,
               CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
                    l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS INTEGER) AS order_item_id,
               'p' || l_partkey AS product_id, 's' || l_suppkey AS seller_id,
               bought + to_days(5) AS shipping_limit_date,
               CAST((500 + (l_partkey * 7919 + l_orderkey * 31) % 45000) * 0.01 AS DECIMAL(10, 2)) AS price,
               CAST((300 + (l_orderkey * 17 + l_suppkey * 13) % 5000) * 0.01 AS DECIMAL(10, 2)) AS freight_value
        FROM lineitem LEFT JOIN base ON l_orderkey = k""",
    "raw_payments": """
        SELECT 'o' || k AS order_id, CAST(n AS INTEGER) AS payment_sequential,
               CASE WHEN n = 2 THEN 'voucher' ELSE kind END AS payment_type,
               CAST(CASE WHEN n = 1 AND kind = 'credit_card' THEN k % 15 ELSE 1 END AS INTEGER) AS payment_installments,
               CASE WHEN n = 1 THEN CAST((1000 + k * 53 % 80000) * 0.01 AS DECIMAL(10, 2))
                    ELSE CAST((500 + k % 3000) * 0.01 AS DECIMAL(10, 2)) END AS payment_value
        FROM (SELECT *, CASE WHEN k % 333 = 0 THEN 0 WHEN k % 10 = 0 THEN 2 ELSE 1 END AS payments,
                     CASE o_orderpriority[1] WHEN '1' THEN 'credit_card' WHEN '3' THEN 'credit_card'
                          WHEN '2' THEN 'boleto' WHEN '4' THEN 'debit_card' ELSE 'voucher' END AS kind FROM base) b
        JOIN (VALUES (1), (2)) s(n) ON n <= payments""",
    "raw_reviews": """
        SELECT 'r' || k || '_' || n AS review_id, 'o' || k AS order_id,
               CAST(CASE WHEN n = 1 THEN 1 + (k * 7 + k % 3) % 5 ELSE 1 + k % 5 END AS INTEGER) AS review_score,
               CASE WHEN n = 1 AND k % 4 = 0 THEN 'title ' || k END AS review_comment_title,
               CASE WHEN n = 1 AND k % 3 <> 0 THEN repeat('x', CAST(1 + k % 300 AS INTEGER)) END AS review_comment_message,
               created AS review_creation_date,
               CASE WHEN n = 1 AND k % 50 <> 7 THEN created + to_days(CAST(k % 40 AS INTEGER)) END AS review_answer_timestamp
        FROM (SELECT k, n, due + to_days(CAST(k % 45 - 15 + n AS INTEGER)) AS created
              FROM (SELECT *, CASE WHEN k % 25 = 0 THEN 0 WHEN k % 180 = 1 THEN 2 ELSE 1 END AS written FROM base) b
              JOIN (VALUES (1), (2)) s(n) ON n <= written) r""",
    "raw_products": """
        SELECT id AS product_id, CASE WHEN x % 60 <> 0 THEN 'cat_' || (x % 12) END AS product_category_name,
               CASE WHEN x % 17 <> 0 THEN CAST(length(name) AS INTEGER) END AS product_name_lenght,
               CAST(100 + x % 900 AS INTEGER) AS product_description_lenght, CAST(x % 7 AS INTEGER) AS product_photos_qty,
               CAST(CASE WHEN x % 61 <> 0 THEN size * 150 END AS DECIMAL(10, 2)) AS product_weight_g,
               CAST(10 + size * 2 AS DECIMAL(10, 2)) AS product_length_cm,
               CAST(2 + x % 40 AS DECIMAL(10, 2)) AS product_height_cm, CAST(10 + x % 60 AS DECIMAL(10, 2)) AS product_width_cm
        FROM (SELECT 'p' || p_partkey AS id, p_partkey AS x, p_name AS name, p_size AS size FROM part
              UNION ALL SELECT 'pn' || n_nationkey, n_nationkey, n_name, n_regionkey FROM nation) p""",
    "raw_category_translation": "SELECT c.* FROM (VALUES "
    + ", ".join(f"('cat_{n}', {quote(e)})" for n, e in CATEGORY_ENGLISH.items())
    + ") c(product_category_name, product_category_name_english) WHERE product_category_name IN"
    + " (SELECT 'cat_' || p_partkey % 12 FROM part UNION SELECT 'cat_99' FROM part)",
    "raw_geolocation": """
        SELECT zip AS geolocation_zip_code_prefix,
               CAST(-30 + (CAST(zip AS INTEGER) - 10000) * 0.01 + d * 0.001 AS DECIMAL(10, 6)) AS geolocation_lat,
               CAST(-60 + (CAST(zip AS INTEGER) - 10000) * 0.005 + d * 0.001 AS DECIMAL(10, 6)) AS geolocation_lng,
               city AS geolocation_city, state AS geolocation_state
        FROM (SELECT customer_zip_code_prefix AS zip, min(customer_city) AS city, min(customer_state) AS state
              FROM raw_customers GROUP BY ALL) z, (VALUES (0), (1), (2)) s(d)""",
}

_OVER = "order_delivered_customer_date"

STAGING = {
    "stg_orders": f"""
        SELECT *, CAST(order_purchase_timestamp AS DATE) AS order_date,
               CAST(date_trunc('month', order_purchase_timestamp) AS DATE) AS order_month,
               CAST(date_trunc('year', order_purchase_timestamp) AS DATE) AS order_year,
               epoch(order_approved_at - order_purchase_timestamp) / 3600.0 AS hours_to_approval,
               epoch({_OVER} - order_purchase_timestamp) / 86400.0 AS days_to_delivery,
               CASE sign(epoch({_OVER} - order_estimated_delivery_date)) WHEN -1 THEN 'early' WHEN 0 THEN 'on_time' WHEN 1 THEN 'late' END AS delivery_performance,
               epoch({_OVER} - order_estimated_delivery_date) / 86400.0 AS days_vs_estimated
        FROM raw_orders WHERE order_id IS NOT NULL""",
    "stg_order_items": """
        SELECT *, price + freight_value AS total_item_value, price AS item_revenue, freight_value AS freight_revenue
        FROM raw_order_items WHERE order_id IS NOT NULL AND order_item_id IS NOT NULL""",
    "stg_payments": f"""
        SELECT *, {mapping("payment_type", v.PAYMENT_TYPE_DISPLAY, quote(v.PAYMENT_TYPE_OTHER))} AS payment_type_display
        FROM raw_payments WHERE order_id IS NOT NULL""",
    "stg_reviews": """
        SELECT *, coalesce(review_comment_title, review_comment_message) IS NOT NULL AS has_comment,
               review_answer_timestamp IS NOT NULL AS has_answer,
               CASE WHEN review_score IN (4, 5) THEN 'positive' WHEN review_score = 3 THEN 'neutral' WHEN review_score IN (1, 2) THEN 'negative' END AS review_sentiment
        FROM raw_reviews WHERE review_id IS NOT NULL""",
    "stg_products": """
        SELECT product_id, product_category_name, product_name_lenght AS product_name_length,
               product_description_lenght AS product_description_length, product_photos_qty, product_weight_g,
               product_length_cm, product_height_cm, product_width_cm,
               product_length_cm * product_height_cm * product_width_cm AS product_volume_cm3,
               (product_name_lenght IS NOT NULL)::INTEGER + (product_description_lenght IS NOT NULL)::INTEGER
               + coalesce(product_photos_qty > 0, false)::INTEGER + (product_category_name IS NOT NULL)::INTEGER AS product_completeness_score
        FROM raw_products WHERE product_id IS NOT NULL""",
    "stg_customers": "SELECT *, upper(trim(customer_state)) AS customer_state_clean FROM raw_customers WHERE customer_id IS NOT NULL",
    "stg_sellers": "SELECT *, upper(trim(seller_state)) AS seller_state_clean FROM raw_sellers WHERE seller_id IS NOT NULL",
    "stg_geolocation": """
        SELECT *, upper(trim(geolocation_state)) AS geolocation_state_clean
        FROM (SELECT geolocation_zip_code_prefix, avg(geolocation_lat) AS geolocation_lat, avg(geolocation_lng) AS geolocation_lng,
                     min(geolocation_city) AS geolocation_city, min(geolocation_state) AS geolocation_state
              FROM raw_geolocation WHERE geolocation_zip_code_prefix IS NOT NULL GROUP BY ALL) g""",
    "stg_category_translation": """
        SELECT *, replace(product_category_name_english, '_', ' ') AS category_display_name
        FROM raw_category_translation WHERE product_category_name IS NOT NULL""",
}

INTERMEDIATE = {
    "int_orders_enriched": """
        SELECT stg_orders.*, customer_unique_id, customer_zip_code_prefix, customer_city, customer_state, customer_state_clean,
               review_id, review_score, review_sentiment, has_comment, review_creation_date
        FROM stg_orders LEFT JOIN stg_customers USING (customer_id) LEFT JOIN stg_reviews USING (order_id)""",
    "int_order_items_enriched": """
        SELECT i.*, p.* EXCLUDE (product_id), product_category_name_english, category_display_name, s.* EXCLUDE (seller_id)
        FROM stg_order_items i LEFT JOIN stg_products p USING (product_id)
        LEFT JOIN stg_category_translation t ON p.product_category_name = t.product_category_name
        LEFT JOIN stg_sellers s USING (seller_id)""",
    "int_order_payments_aggregated": """
        SELECT order_id, sum(payment_value) AS total_payment_value, count(*) AS payment_method_count,
               count(DISTINCT payment_type) AS unique_payment_types,
               mode() WITHIN GROUP (ORDER BY payment_type) AS primary_payment_method,
               max(payment_installments) AS max_installments, avg(payment_installments) AS avg_installments,
               coalesce(sum(payment_value) FILTER (payment_type = 'credit_card'), 0) AS credit_card_value,
               coalesce(sum(payment_value) FILTER (payment_type = 'boleto'), 0) AS boleto_value,
               coalesce(sum(payment_value) FILTER (payment_type = 'voucher'), 0) AS voucher_value,
               coalesce(sum(payment_value) FILTER (payment_type = 'debit_card'), 0) AS debit_card_value,
               coalesce(bool_or(payment_type = 'credit_card'), false) AS used_credit_card,
               coalesce(bool_or(payment_type = 'boleto'), false) AS used_boleto,
               coalesce(bool_or(payment_type = 'voucher'), false) AS used_voucher,
               coalesce(bool_or(payment_installments > 1), false) AS used_installments
        FROM stg_payments GROUP BY order_id""",
}

_STATUS_FLAGS = "coalesce(order_status = 'delivered', false) AS is_delivered, coalesce(order_status = 'canceled', false) AS is_canceled"
_YMD = "CAST(strftime({0}, '%Y%m%d') AS INTEGER)"
_BOUGHT_KEY = _YMD.format("order_purchase_timestamp") + " AS order_date_key"
_CTX = "LEFT JOIN stg_orders o USING (order_id) LEFT JOIN stg_customers c ON c.customer_id = o.customer_id"
_ANSWER_DAYS = "date_diff('day', review_creation_date, review_answer_timestamp)"
_WAIT = f"date_diff('day', {_OVER}, review_creation_date)"

FACTS = {
    "fct_orders": f"""
        WITH basket AS (
            SELECT order_id, count(*) AS n, sum(price) AS goods, sum(freight_value) AS ship, sum(total_item_value) AS worth, avg(price) AS typical
            FROM stg_order_items GROUP BY order_id)
        SELECT order_id, customer_id, order_status, order_purchase_timestamp, order_approved_at, order_delivered_carrier_date,
               {_OVER}, order_estimated_delivery_date, order_date, order_month, order_year, hours_to_approval, days_to_delivery,
               delivery_performance, days_vs_estimated, customer_city, customer_state, customer_state_clean, review_id, review_score,
               review_sentiment, has_comment, coalesce(n, 0) AS item_count, coalesce(goods, 0) AS total_item_price,
               coalesce(ship, 0) AS total_freight, coalesce(worth, 0) AS total_order_value, coalesce(typical, 0) AS avg_item_price,
               coalesce(p.total_payment_value, 0) AS total_payment_value, payment_method_count, primary_payment_method,
               max_installments, used_credit_card, used_boleto, used_voucher, used_installments,
               coalesce(p.total_payment_value, 0) - coalesce(worth, 0) AS payment_order_diff, {_STATUS_FLAGS},
               coalesce(review_score > 3, false) AS is_positive_review
        FROM int_orders_enriched LEFT JOIN int_order_payments_aggregated p USING (order_id) LEFT JOIN basket USING (order_id)""",
    "fct_order_items": f"""
        SELECT order_id, order_item_id, product_id, seller_id, o.customer_id, {_BOUGHT_KEY}, shipping_limit_date, price AS item_price,
               freight_value, total_item_value, product_category_name, product_category_name_english, category_display_name,
               product_weight_g, product_length_cm, product_height_cm, product_width_cm, product_volume_cm3,
               seller_zip_code_prefix, seller_city, seller_state, seller_state_clean, order_status, order_purchase_timestamp,
               {_OVER}, order_estimated_delivery_date, customer_zip_code_prefix, customer_city, customer_state,
               CASE WHEN price > 0 THEN CAST(freight_value AS DOUBLE) / CAST(price AS DOUBLE) * 100 END AS freight_percentage,
               {ladder("price", v.PRICE_TIER)} AS price_tier, {ladder("product_volume_cm3", v.VOLUME_TIER)} AS volume_tier,
               coalesce(customer_state = seller_state, false) AS is_same_state,
               coalesce(customer_city = seller_city, false) AS is_same_city, {_STATUS_FLAGS},
               coalesce(order_status = 'shipped', false) AS is_shipped,
               CASE WHEN order_status = 'delivered' THEN coalesce({_OVER} <= order_estimated_delivery_date, false) END AS is_on_time_delivery,
               CASE WHEN order_status = 'delivered' THEN date_diff('day', order_purchase_timestamp, {_OVER}) END AS days_to_deliver,
               CASE WHEN order_status = 'delivered' THEN date_diff('day', {_OVER}, order_estimated_delivery_date) END AS days_vs_estimated
        FROM int_order_items_enriched {_CTX}""",
    "fct_payments": f"""
        SELECT order_id, payment_sequential, o.customer_id, {_BOUGHT_KEY}, payment_type, payment_type_display, payment_installments,
               payment_value, order_status, order_purchase_timestamp, customer_zip_code_prefix, customer_city, customer_state,
               coalesce(payment_type = 'credit_card', false) AS is_credit_card, coalesce(payment_type = 'boleto', false) AS is_boleto,
               coalesce(payment_type = 'voucher', false) AS is_voucher, coalesce(payment_type = 'debit_card', false) AS is_debit_card,
               coalesce(payment_installments > 1, false) AS uses_installments,
               {ladder("payment_installments", v.INSTALLMENT_CATEGORY)} AS installment_category,
               {ladder("payment_value", v.PAYMENT_VALUE_TIER)} AS payment_value_tier,
               CAST(payment_value AS DOUBLE) / CASE WHEN payment_installments > 0 THEN payment_installments ELSE 1 END AS installment_value,
               coalesce(payment_sequential = 1, false) AS is_primary_payment, {_STATUS_FLAGS}
        FROM stg_payments {_CTX}""",
    "fct_reviews": f"""
        SELECT review_id, order_id, o.customer_id, {_YMD.format("review_creation_date")} AS review_date_key, {_BOUGHT_KEY},
               review_score, review_comment_title, review_comment_message, review_creation_date, review_answer_timestamp,
               review_sentiment, has_comment, has_answer,
               {mapping("review_score", v.REVIEW_SCORE_CATEGORIES, quote(v.REVIEW_SCORE_UNKNOWN))} AS review_score_category,
               coalesce(review_sentiment = 'positive', false) AS is_positive, coalesce(review_sentiment = 'neutral', false) AS is_neutral,
               coalesce(review_sentiment = 'negative', false) AS is_negative, order_status, order_purchase_timestamp, {_OVER},
               customer_zip_code_prefix, customer_city, customer_state, coalesce(worth, 0) AS order_value, coalesce(n, 0) AS order_item_count,
               date_diff('day', order_purchase_timestamp, review_creation_date) AS days_order_to_review,
               {_WAIT} AS days_delivery_to_review, {_ANSWER_DAYS} AS days_to_answer,
               {ladder(_WAIT, v.REVIEW_TIMING)} AS review_timing,
               coalesce(length(review_comment_title), 0) AS title_length, coalesce(length(review_comment_message), 0) AS message_length,
               {ladder("length(review_comment_message)", v.COMMENT_DETAIL)} AS comment_detail_level,
               CASE WHEN review_answer_timestamp IS NULL THEN {quote(v.ANSWER_MISSING)} ELSE {ladder(_ANSWER_DAYS, v.ANSWER_TIMING)} END AS answer_timing,
               {_STATUS_FLAGS}
        FROM stg_reviews {_CTX}
        LEFT JOIN (SELECT order_id, count(*) AS n, sum(price) AS worth FROM stg_order_items GROUP BY order_id) b USING (order_id)""",
}

_TODAY = "(SELECT CAST(max(order_purchase_timestamp) AS DATE) FROM stg_orders)"

DIMENSIONS = {
    "dim_customers": f"""
        SELECT md5(customer_id) AS customer_key, c.*, coalesce(n, 0) AS lifetime_orders, first_order_date, last_order_date,
               avg_review_score, coalesce(delivered, 0) AS delivered_orders, coalesce(canceled, 0) AS canceled_orders,
               {ladder("n", v.CUSTOMER_SEGMENT)} AS customer_segment,
               date_diff('day', last_order_date, {_TODAY}) AS days_since_last_order
        FROM stg_customers c LEFT JOIN (
            SELECT customer_id, count(DISTINCT order_id) AS n, min(order_purchase_timestamp) AS first_order_date,
                   max(order_purchase_timestamp) AS last_order_date, avg(review_score) AS avg_review_score,
                   count(DISTINCT order_id) FILTER (order_status = 'delivered') AS delivered,
                   count(DISTINCT order_id) FILTER (order_status = 'canceled') AS canceled
            FROM int_orders_enriched GROUP BY customer_id) h USING (customer_id)""",
    "dim_products": f"""
        SELECT product_id, p.product_category_name, product_category_name_english, category_display_name,
               p.* EXCLUDE (product_id, product_category_name),
               {ladder("product_completeness_score", v.QUALITY_TIER)} AS product_quality_tier,
               {ladder("product_volume_cm3", v.VOLUME_TIER)} AS product_size_category,
               {ladder("product_weight_g", v.WEIGHT_TIER)} AS product_weight_category,
               coalesce(n, 0) AS total_orders, coalesce(sold, 0) AS total_items_sold, coalesce(revenue, 0) AS total_revenue,
               avg_price, min_price, max_price, coalesce(freight, 0) AS total_freight, avg_freight,
               {ladder("sold", v.PRODUCT_SALES_TIER)} AS product_performance_tier
        FROM stg_products p LEFT JOIN stg_category_translation t ON p.product_category_name = t.product_category_name
        LEFT JOIN (SELECT product_id, count(DISTINCT order_id) AS n, count(*) AS sold, sum(price) AS revenue, avg(price) AS avg_price,
                          min(price) AS min_price, max(price) AS max_price, sum(freight_value) AS freight, avg(freight_value) AS avg_freight
                   FROM stg_order_items GROUP BY product_id) s USING (product_id)""",
    "dim_sellers": f"""
        WITH lines AS (SELECT i.*, o.* EXCLUDE (order_id) FROM stg_order_items i LEFT JOIN stg_orders o USING (order_id)),
        sales AS (
            SELECT seller_id, count(DISTINCT order_id) AS n, count(*) AS sold, sum(price) AS revenue, avg(price) AS avg_item_price,
                   sum(freight_value) AS freight, avg(freight_value) AS avg_freight, min(order_purchase_timestamp) AS first_sale_date,
                   max(order_purchase_timestamp) AS last_sale_date, count(DISTINCT product_id) AS products
            FROM lines GROUP BY seller_id),
        voices AS (
            SELECT seller_id, avg(review_score) AS avg_review_score, count(DISTINCT review_id) AS reviews,
                   count(DISTINCT review_id) FILTER (review_score > 3) AS liked, count(DISTINCT review_id) FILTER (review_score < 3) AS disliked
            FROM stg_order_items JOIN stg_reviews USING (order_id) GROUP BY seller_id),
        trips AS (
            SELECT seller_id, avg(date_diff('day', order_purchase_timestamp, {_OVER})) AS avg_delivery_days,
                   count(DISTINCT order_id) FILTER ({_OVER} <= order_estimated_delivery_date) AS kept,
                   count(DISTINCT order_id) FILTER (order_status = 'delivered') AS delivered
            FROM lines WHERE order_status IN ('delivered', 'shipped') GROUP BY seller_id)
        SELECT s.*, coalesce(n, 0) AS total_orders, coalesce(sold, 0) AS total_items_sold, coalesce(revenue, 0) AS total_revenue,
               avg_item_price, coalesce(freight, 0) AS total_freight, avg_freight, first_sale_date, last_sale_date,
               coalesce(products, 0) AS unique_products_sold, avg_review_score, coalesce(liked, 0) AS positive_reviews,
               coalesce(disliked, 0) AS negative_reviews, coalesce(reviews, 0) AS total_reviews,
               {pct("liked", "reviews")} AS positive_review_rate, avg_delivery_days, coalesce(kept, 0) AS on_time_deliveries,
               coalesce(delivered, 0) AS total_delivered_orders, {pct("kept", "delivered")} AS on_time_delivery_rate,
               date_diff('day', first_sale_date, last_sale_date) AS days_active,
               CASE {" ".join(f"WHEN revenue >= {r} AND avg_review_score >= {x} THEN {quote(t)}" for r, x, t in v.SELLER_PERFORMANCE_STEPS)}
                    WHEN revenue > 0 THEN 'Low Performer' ELSE 'No Sales' END AS seller_performance_tier,
               {ladder("sold", v.SELLER_SIZE_TIER)} AS seller_size_tier
        FROM stg_sellers s LEFT JOIN sales USING (seller_id) LEFT JOIN voices USING (seller_id) LEFT JOIN trips USING (seller_id)""",
    "dim_category": f"""
        SELECT t.*, coalesce(products, 0) AS total_products, coalesce(n, 0) AS total_orders, coalesce(sold, 0) AS total_items_sold,
               coalesce(revenue, 0) AS total_revenue, avg_item_price, min_item_price, max_item_price,
               coalesce(freight, 0) AS total_freight, avg_freight,
               CASE WHEN products > 0 THEN CAST(coalesce(revenue, 0) AS DOUBLE) / products ELSE 0 END AS revenue_per_product,
               {ladder("revenue", v.CATEGORY_REVENUE_TIER)} AS revenue_tier, {ladder("sold", v.CATEGORY_SIZE_TIER)} AS category_size_tier,
               {ladder("avg_item_price", v.CATEGORY_PRICE_TIER)} AS price_tier, {ladder("avg_freight", v.FREIGHT_TIER)} AS freight_tier,
               {membership("product_category_name_english", v.CATEGORY_GROUPS, v.CATEGORY_GROUP_OTHER)} AS category_group
        FROM stg_category_translation t
        LEFT JOIN (SELECT product_category_name, count(DISTINCT product_id) AS products FROM stg_products GROUP BY ALL) p USING (product_category_name)
        LEFT JOIN (SELECT product_category_name, count(DISTINCT order_id) AS n, count(*) AS sold, sum(price) AS revenue,
                          avg(price) AS avg_item_price, min(price) AS min_item_price, max(price) AS max_item_price,
                          sum(freight_value) AS freight, avg(freight_value) AS avg_freight
                   FROM stg_order_items JOIN stg_products USING (product_id) GROUP BY ALL) s USING (product_category_name)""",
    "dim_geography": f"""
        WITH spots AS (
            SELECT customer_zip_code_prefix AS zip, customer_city AS city, customer_state AS state, customer_state_clean AS clean,
                   customer_id AS buyer, NULL AS vendor FROM stg_customers
            UNION ALL SELECT seller_zip_code_prefix, seller_city, seller_state, seller_state_clean, NULL, seller_id FROM stg_sellers),
        places AS (
            SELECT zip AS zip_code_prefix, min(city) AS city, min(state) AS state, min(clean) AS state_clean,
                   count(DISTINCT buyer) AS customer_count, count(DISTINCT vendor) AS seller_count
            FROM spots GROUP BY zip)
        SELECT zip_code_prefix, city, state, state_clean, geolocation_lat AS latitude, geolocation_lng AS longitude,
               geolocation_lat IS NOT NULL AND geolocation_lng IS NOT NULL AS has_coordinates, customer_count, seller_count,
               customer_count + seller_count AS total_entities,
               CASE WHEN least(customer_count, seller_count) > 0 THEN 'Both' WHEN customer_count > 0 THEN 'Customer Only'
                    WHEN seller_count > 0 THEN 'Seller Only' ELSE 'Unknown' END AS location_type,
               {membership("state_clean", v.REGION_STATES, v.REGION_UNKNOWN)} AS region,
               {mapping("state_clean", v.STATE_NAMES, "state")} AS state_name,
               {ladder("(customer_count + seller_count)", v.CITY_SIZE_TIER)} AS city_size_tier
        FROM places LEFT JOIN stg_geolocation ON zip_code_prefix = geolocation_zip_code_prefix""",
    "dim_date": f"""
        SELECT {_YMD.format("date_day")} AS date_key, date_day, year(date_day) AS year, year(date_day) AS year_number,
               strftime(date_day, '%Y') AS year_name, quarter(date_day) AS quarter,
               strftime(date_day, '%Y') || '-Q' || quarter(date_day) AS quarter_name, month(date_day) AS month_number,
               monthname(date_day) AS month_name, strftime(date_day, '%b') AS month_name_short, strftime(date_day, '%Y-%m') AS year_month,
               weekofyear(date_day) AS week_of_year, dayofweek(date_day) AS day_of_week, dayname(date_day) AS day_name,
               strftime(date_day, '%a') AS day_name_short, day(date_day) AS day_of_month, dayofyear(date_day) AS day_of_year,
               isodow(date_day) > 5 AS is_weekend, isodow(date_day) < 6 AS is_weekday, day(date_day) = 1 AS is_month_start,
               date_day = last_day(date_day) AS is_month_end,
               date_day = date_trunc('quarter', date_day) AS is_quarter_start,
               date_day + 1 = date_trunc('quarter', date_day + 1) AS is_quarter_end,
               date_day = date_trunc('year', date_day) AS is_year_start,
               date_day + 1 = date_trunc('year', date_day + 1) AS is_year_end,
               year(date_day) AS fiscal_year, quarter(date_day) AS fiscal_quarter, holiday AS holiday_name,
               holiday IS NOT NULL AS is_holiday
        FROM (SELECT CAST(unnest(generate_series(min(CAST(order_purchase_timestamp AS DATE)), max(CAST(order_purchase_timestamp AS DATE)), INTERVAL 1 DAY)) AS DATE) AS date_day
              FROM stg_orders) d
        LEFT JOIN (VALUES {", ".join(f"({m}, {d}, {quote(h)})" for m, d, h in v.HOLIDAYS)}) f(m, d, holiday)
               ON month(date_day) = m AND day(date_day) = d""",
}

_FAN = """
    FROM dim_date d LEFT JOIN fct_orders o ON o.order_date = d.date_day
    LEFT JOIN fct_order_items i ON i.order_id = o.order_id
    LEFT JOIN fct_payments p ON p.order_id = o.order_id AND p.is_primary_payment
    LEFT JOIN fct_reviews r ON r.order_id = o.order_id"""


def _executive(day_rows: str) -> str:
    return f"""
        WITH days AS ({day_rows})
        SELECT *, {pct("delivered_orders", "total_orders")} AS delivery_rate, {pct("canceled_orders", "total_orders")} AS cancellation_rate,
               {pct("positive_reviews", "total_reviews")} AS positive_review_rate,
               {pct("on_time_deliveries", "delivered_orders")} AS on_time_delivery_rate,
               {pct("installment_orders", "total_orders")} AS installment_usage_rate,
               {per("total_revenue", "unique_customers")} AS revenue_per_customer,
               avg(total_orders) OVER w7 AS ma7_orders, avg(total_revenue) OVER w7 AS ma7_revenue, avg(avg_review_score) OVER w7 AS ma7_review_score,
               avg(total_orders) OVER w30 AS ma30_orders, avg(total_revenue) OVER w30 AS ma30_revenue,
               sum(total_revenue) OVER ytd AS ytd_revenue, CAST(sum(total_orders) OVER ytd AS BIGINT) AS ytd_orders
        FROM days WINDOW w7 AS (ORDER BY date_day ROWS 6 PRECEDING), w30 AS (ORDER BY date_day ROWS 29 PRECEDING),
               ytd AS (PARTITION BY year ORDER BY date_day)"""


_DAY_COLUMNS = "d.date_day, d.year, d.quarter, d.month_name, d.year_month, d.day_name, d.is_weekend, d.is_holiday, d.holiday_name"

_FANOUT_DAYS = f"""
    SELECT {_DAY_COLUMNS}, count(DISTINCT o.order_id) AS total_orders,
           count(DISTINCT o.order_id) FILTER (o.is_delivered) AS delivered_orders,
           count(DISTINCT o.order_id) FILTER (o.is_canceled) AS canceled_orders,
           sum(o.total_order_value) AS total_revenue, sum(o.total_freight) AS total_freight, sum(o.total_payment_value) AS total_payments,
           avg(o.total_order_value) AS avg_order_value, count(DISTINCT o.customer_id) AS unique_customers,
           CAST(sum(o.item_count) AS BIGINT) AS total_items, avg(o.item_count) AS avg_items_per_order,
           count(DISTINCT r.review_id) AS total_reviews, avg(r.review_score) AS avg_review_score,
           count(DISTINCT r.review_id) FILTER (r.is_positive) AS positive_reviews,
           count(DISTINCT r.review_id) FILTER (r.is_negative) AS negative_reviews,
           count(DISTINCT p.order_id) FILTER (p.is_credit_card) AS credit_card_orders,
           count(DISTINCT p.order_id) FILTER (p.is_boleto) AS boleto_orders,
           count(DISTINCT p.order_id) FILTER (p.uses_installments) AS installment_orders,
           avg(o.days_to_delivery) FILTER (o.is_delivered) AS avg_delivery_days,
           count(DISTINCT o.order_id) FILTER (o.is_delivered AND o.delivery_performance = 'on_time') AS on_time_deliveries,
           count(DISTINCT o.order_id) FILTER (o.is_delivered AND o.days_vs_estimated <= 0) AS on_or_before_estimate,
           count(DISTINCT i.seller_id) AS unique_sellers, count(DISTINCT i.product_id) AS unique_products
    {_FAN} GROUP BY ALL"""

_SAFE_DAYS = f"""
    SELECT {_DAY_COLUMNS}, coalesce(a.total_orders, 0) AS total_orders, coalesce(a.delivered_orders, 0) AS delivered_orders,
           coalesce(a.canceled_orders, 0) AS canceled_orders, total_revenue, total_freight, total_payments, avg_order_value,
           coalesce(a.unique_customers, 0) AS unique_customers, total_items, avg_items_per_order,
           coalesce(b.total_reviews, 0) AS total_reviews, avg_review_score, coalesce(b.positive_reviews, 0) AS positive_reviews,
           coalesce(b.negative_reviews, 0) AS negative_reviews, coalesce(c.credit_card_orders, 0) AS credit_card_orders,
           coalesce(c.boleto_orders, 0) AS boleto_orders, coalesce(c.installment_orders, 0) AS installment_orders, avg_delivery_days,
           coalesce(a.on_time_deliveries, 0) AS on_time_deliveries, coalesce(a.on_or_before_estimate, 0) AS on_or_before_estimate,
           coalesce(e.unique_sellers, 0) AS unique_sellers, coalesce(e.unique_products, 0) AS unique_products
    FROM dim_date d
    LEFT JOIN (SELECT order_date AS date_day, count(*) AS total_orders, count(*) FILTER (is_delivered) AS delivered_orders,
                      count(*) FILTER (is_canceled) AS canceled_orders, sum(total_order_value) AS total_revenue,
                      sum(total_freight) AS total_freight, sum(total_payment_value) AS total_payments,
                      avg(total_order_value) AS avg_order_value, count(DISTINCT customer_id) AS unique_customers,
                      CAST(sum(item_count) AS BIGINT) AS total_items, avg(item_count) AS avg_items_per_order,
                      avg(days_to_delivery) FILTER (is_delivered) AS avg_delivery_days,
                      count(*) FILTER (is_delivered AND delivery_performance = 'on_time') AS on_time_deliveries,
                      count(*) FILTER (is_delivered AND days_vs_estimated <= 0) AS on_or_before_estimate
               FROM (SELECT DISTINCT order_id, order_date, is_delivered, is_canceled, total_order_value, total_freight, total_payment_value,
                            customer_id, item_count, days_to_delivery, delivery_performance, days_vs_estimated FROM fct_orders) x
               GROUP BY ALL) a USING (date_day)
    LEFT JOIN (SELECT CAST(order_purchase_timestamp AS DATE) AS date_day, count(*) AS total_reviews, avg(review_score) AS avg_review_score,
                      count(*) FILTER (is_positive) AS positive_reviews, count(*) FILTER (is_negative) AS negative_reviews
               FROM fct_reviews GROUP BY ALL) b USING (date_day)
    LEFT JOIN (SELECT CAST(order_purchase_timestamp AS DATE) AS date_day, count(*) FILTER (is_credit_card) AS credit_card_orders,
                      count(*) FILTER (is_boleto) AS boleto_orders, count(*) FILTER (uses_installments) AS installment_orders
               FROM fct_payments WHERE is_primary_payment GROUP BY ALL) c USING (date_day)
    LEFT JOIN (SELECT CAST(order_purchase_timestamp AS DATE) AS date_day, count(DISTINCT seller_id) AS unique_sellers,
                      count(DISTINCT product_id) AS unique_products FROM fct_order_items GROUP BY ALL) e USING (date_day)"""

_SAME_STATE = pct("same_state_orders", "line_orders")

MARTS = {
    "mart_customer_analytics": f"""
        WITH history AS (
            SELECT customer_id, max(order_purchase_timestamp) AS last_order_date, min(order_purchase_timestamp) AS first_order_date,
                   count(DISTINCT order_id) AS n, sum(total_order_value) AS revenue,
                   date_diff('day', max(order_purchase_timestamp), {_TODAY}) AS recency_days, avg(total_order_value) AS avg_order_value,
                   CAST(sum(item_count) AS BIGINT) AS items, avg(item_count) AS avg_items_per_order, sum(total_freight) AS freight,
                   avg(total_freight) AS avg_freight_per_order, count(DISTINCT order_id) FILTER (is_delivered) AS delivered,
                   count(DISTINCT order_id) FILTER (is_canceled) AS canceled, count(DISTINCT order_id) FILTER (used_installments) AS split,
                   avg(max_installments) AS avg_max_installments, avg(days_to_delivery) AS avg_delivery_days,
                   count(DISTINCT order_id) FILTER (delivery_performance = 'on_time') AS exact,
                   count(DISTINCT order_id) FILTER (days_vs_estimated <= 0) AS kept, avg(review_score) AS avg_review_score,
                   count(DISTINCT order_id) FILTER (has_comment) AS commented,
                   date_diff('day', min(order_purchase_timestamp), max(order_purchase_timestamp)) AS span
            FROM fct_orders SEMI JOIN dim_customers USING (customer_id) GROUP BY customer_id),
        tastes AS (
            SELECT o.customer_id, count(DISTINCT product_id) AS products, count(DISTINCT product_category_name_english) AS categories,
                   mode() WITHIN GROUP (ORDER BY product_category_name_english) AS favorite_category
            FROM fct_orders o JOIN fct_order_items i USING (order_id) WHERE product_category_name_english IS NOT NULL GROUP BY ALL),
        scores AS (
            SELECT customer_id, 6 - ntile(5) OVER (ORDER BY recency_days, customer_id) AS r, ntile(5) OVER (ORDER BY n, customer_id) AS f,
                   ntile(5) OVER (ORDER BY revenue, customer_id) AS m FROM history WHERE recency_days IS NOT NULL)
        SELECT customer_key, customer_id, customer_unique_id, customer_zip_code_prefix, customer_city, customer_state, customer_state_clean,
               region, city_size_tier, customer_segment, days_since_last_order, coalesce(n, 0) AS total_orders,
               coalesce(delivered, 0) AS delivered_orders, coalesce(canceled, 0) AS canceled_orders, h.first_order_date, h.last_order_date,
               coalesce(revenue, 0) AS lifetime_value, avg_order_value, coalesce(items, 0) AS total_items, avg_items_per_order,
               coalesce(freight, 0) AS total_freight, avg_freight_per_order, recency_days, coalesce(n, 0) AS frequency, revenue AS monetary_value,
               coalesce(r, 0) AS recency_score, coalesce(f, 0) AS frequency_score, coalesce(m, 0) AS monetary_score,
               coalesce(r, 0) + coalesce(f, 0) + coalesce(m, 0) AS rfm_total_score,
               CASE WHEN r >= 4 AND f >= 4 AND m >= 4 THEN 'Champions' WHEN r >= 3 AND f >= 3 AND m >= 3 THEN 'Loyal Customers'
                    WHEN r >= 4 AND f < 3 THEN 'New Customers' WHEN r < 3 AND f >= 3 THEN 'At Risk' WHEN r < 3 AND f < 3 THEN 'Lost'
                    WHEN m > 3 THEN 'Big Spenders' ELSE 'Regular' END AS rfm_segment,
               CASE WHEN n > 1 THEN CAST(span AS DOUBLE) / (n - 1) END AS avg_days_between_orders, coalesce(split, 0) AS installment_orders,
               avg_max_installments, avg_delivery_days, coalesce(exact, 0) AS on_time_deliveries,
               {pct("exact", "delivered")} AS on_time_delivery_rate, coalesce(kept, 0) AS on_or_before_estimate, h.avg_review_score,
               coalesce(commented, 0) AS orders_with_comments, coalesce(products, 0) AS unique_products_purchased,
               coalesce(categories, 0) AS unique_categories_purchased, favorite_category,
               {ladder("revenue", v.CUSTOMER_VALUE_TIER)} AS value_tier,
               CASE WHEN n IS NULL THEN 'Never Purchased' WHEN recency_days <= 90 THEN if(n >= 3, 'Active Repeat', 'Active New')
                    WHEN recency_days <= 180 THEN 'Cooling Down' WHEN recency_days <= 365 THEN 'At Risk' ELSE 'Dormant' END AS lifecycle_stage
        FROM dim_customers LEFT JOIN history h USING (customer_id) LEFT JOIN scores USING (customer_id) LEFT JOIN tastes USING (customer_id)
        LEFT JOIN dim_geography ON customer_zip_code_prefix = zip_code_prefix""",
    "mart_executive_dashboard": _executive(_FANOUT_DAYS),
    "mart_executive_dashboard_fanout_safe": _executive(_SAFE_DAYS),
    "mart_product_performance": f"""
        WITH sales AS (
            SELECT product_id, count(DISTINCT order_id) AS n, count(*) AS sold, sum(item_price) AS revenue, avg(item_price) AS avg_price,
                   min(item_price) AS min_price, max(item_price) AS max_price, sum(freight_value) AS freight, avg(freight_value) AS avg_freight,
                   avg(freight_percentage) AS avg_freight_percentage, min(order_purchase_timestamp) AS first_sale_date,
                   max(order_purchase_timestamp) AS last_sale_date, count(DISTINCT order_id) FILTER (is_delivered) AS delivered,
                   count(DISTINCT order_id) FILTER (is_canceled) AS canceled, count(DISTINCT order_id) FILTER (is_on_time_delivery) AS kept,
                   avg(days_to_deliver) FILTER (is_delivered) AS avg_delivery_days, count(DISTINCT customer_zip_code_prefix) AS zips,
                   count(DISTINCT customer_state) AS states, mode() WITHIN GROUP (ORDER BY customer_state) AS top_customer_state,
                   count(DISTINCT order_id) FILTER (is_same_state) AS near_state, count(DISTINCT order_id) FILTER (is_same_city) AS near_city,
                   count(DISTINCT seller_id) AS vendors, mode() WITHIN GROUP (ORDER BY seller_id) AS primary_seller_id
            FROM fct_order_items GROUP BY product_id),
        voices AS (
            SELECT product_id, count(DISTINCT review_id) AS reviews, avg(review_score) AS avg_review_score,
                   count(DISTINCT review_id) FILTER (is_positive) AS liked, count(DISTINCT review_id) FILTER (is_neutral) AS unsure,
                   count(DISTINCT review_id) FILTER (is_negative) AS disliked, count(DISTINCT review_id) FILTER (has_comment) AS commented,
                   avg(days_delivery_to_review) AS avg_days_to_review
            FROM fct_order_items JOIN fct_reviews USING (order_id) GROUP BY product_id)
        SELECT md5(product_id) AS product_key, product_id, p.product_category_name, p.product_category_name_english, p.category_display_name,
               category_group, revenue_tier AS category_revenue_tier, category_size_tier, product_weight_g, product_length_cm, product_height_cm,
               product_width_cm, product_volume_cm3, product_size_category, product_weight_category, product_completeness_score,
               product_quality_tier, coalesce(n, 0) AS total_orders, coalesce(sold, 0) AS total_units_sold, coalesce(revenue, 0) AS total_revenue,
               s.avg_price, s.min_price, s.max_price, coalesce(freight, 0) AS total_freight, s.avg_freight, avg_freight_percentage,
               first_sale_date, last_sale_date, date_diff('day', first_sale_date, last_sale_date) AS days_on_sale,
               coalesce(delivered, 0) AS delivered_orders, coalesce(canceled, 0) AS canceled_orders, {pct("delivered", "n")} AS delivery_rate,
               {pct("canceled", "n")} AS cancellation_rate, coalesce(kept, 0) AS on_time_deliveries,
               {pct("kept", "delivered")} AS on_time_delivery_rate, avg_delivery_days, coalesce(zips, 0) AS unique_customer_locations,
               coalesce(states, 0) AS unique_customer_states, top_customer_state, coalesce(near_state, 0) AS same_state_sales,
               coalesce(near_city, 0) AS same_city_sales, {pct("near_state", "n")} AS same_state_sales_rate,
               coalesce(reviews, 0) AS total_reviews, avg_review_score, coalesce(liked, 0) AS positive_reviews,
               coalesce(unsure, 0) AS neutral_reviews, coalesce(disliked, 0) AS negative_reviews, {pct("liked", "reviews")} AS positive_review_rate,
               coalesce(commented, 0) AS reviews_with_comments, avg_days_to_review, coalesce(vendors, 0) AS unique_sellers, primary_seller_id,
               {ladder("sold", v.MART_SALES_TIER)} AS sales_tier, {ladder("avg_review_score", v.MART_REVIEW_TIER)} AS review_tier,
               CASE WHEN sold > 0 THEN least(sold / 2.0, 50) / 10 + avg_review_score END AS performance_score,
               {per("revenue", "sold")} AS revenue_per_unit
        FROM dim_products p LEFT JOIN sales s USING (product_id) LEFT JOIN voices USING (product_id)
        LEFT JOIN dim_category c ON p.product_category_name = c.product_category_name""",
    "mart_seller_scorecard": f"""
        WITH recent AS (SELECT *, date_diff('day', order_purchase_timestamp, max(order_purchase_timestamp) OVER ()) AS age FROM fct_order_items),
        sales AS (
            SELECT seller_id, count(DISTINCT product_category_name_english) AS categories,
                   mode() WITHIN GROUP (ORDER BY product_category_name_english) FILTER (product_category_name_english IS NOT NULL) AS top_category,
                   count(DISTINCT customer_zip_code_prefix) AS zips, count(DISTINCT customer_state) AS states,
                   mode() WITHIN GROUP (ORDER BY customer_state) AS top_customer_state,
                   count(DISTINCT order_id) FILTER (is_same_state) AS same_state_orders, count(DISTINCT order_id) FILTER (is_same_city) AS same_city_orders,
                   count(DISTINCT order_id) AS line_orders, avg(item_price) AS avg_product_price, min(item_price) AS min_product_price,
                   max(item_price) AS max_product_price, stddev_samp(item_price) AS price_stddev, avg(freight_percentage) AS avg_freight_percentage,
                   count(DISTINCT date_trunc('month', order_purchase_timestamp)) AS months,
                   count(DISTINCT order_id) FILTER (age <= 30) AS d30, count(DISTINCT order_id) FILTER (age <= 90) AS d90,
                   count(DISTINCT order_id) FILTER (age <= 180) AS d180
            FROM recent GROUP BY seller_id),
        ranked AS (SELECT *, 100 * percent_rank() OVER (ORDER BY total_revenue) AS revenue_percentile FROM dim_sellers),
        wide AS (
            SELECT *, {_SAME_STATE} AS same_state_order_rate, on_time_delivery_rate AS otr
            FROM ranked LEFT JOIN sales USING (seller_id) LEFT JOIN dim_geography ON seller_zip_code_prefix = zip_code_prefix)
        SELECT md5(seller_id) AS seller_key, seller_id, seller_zip_code_prefix, seller_city, seller_state, seller_state_clean, region,
               city_size_tier, seller_performance_tier, seller_size_tier, total_orders, total_items_sold, total_revenue, avg_item_price,
               total_freight, avg_freight, first_sale_date, last_sale_date, days_active, coalesce(months, 0) AS active_months,
               coalesce(d30, 0) AS orders_last_30_days, coalesce(d90, 0) AS orders_last_90_days, coalesce(d180, 0) AS orders_last_180_days,
               unique_products_sold, coalesce(categories, 0) AS unique_categories, top_category, avg_product_price, min_product_price,
               max_product_price, price_stddev, avg_freight_percentage, coalesce(zips, 0) AS unique_customer_locations,
               coalesce(states, 0) AS unique_customer_states, top_customer_state, coalesce(same_state_orders, 0) AS same_state_orders,
               coalesce(same_city_orders, 0) AS same_city_orders, same_state_order_rate, avg_review_score, positive_reviews, negative_reviews,
               total_reviews, positive_review_rate, avg_delivery_days, on_time_deliveries, total_delivered_orders, on_time_delivery_rate,
               {per("total_revenue", "total_items_sold")} AS revenue_per_item, {per("total_revenue", "total_orders")} AS revenue_per_order,
               {per("total_revenue", "days_active")} AS revenue_per_day_active, {per("total_revenue", "months")} AS revenue_per_month,
               CASE WHEN d30 > 0 THEN 'Active (30d)' WHEN d90 > 0 THEN 'Recent (90d)' WHEN d180 > 0 THEN 'Cooling (180d)'
                    WHEN total_orders > 0 THEN 'Inactive' ELSE 'No Sales' END AS activity_status,
               revenue_percentile, 20 * avg_review_score AS review_score_100, otr AS delivery_score_100,
               0.4 * revenue_percentile + 6 * avg_review_score + 0.3 * otr AS overall_performance_score,
               CASE WHEN avg_review_score >= 4.5 AND otr >= 90 AND d90 > 0 THEN 'Excellent'
                    WHEN avg_review_score >= 4 AND otr >= 80 AND d90 > 0 THEN 'Good' WHEN avg_review_score >= 3.5 AND otr >= 70 THEN 'Average'
                    WHEN avg_review_score < 3.5 OR otr < 70 THEN 'Needs Improvement' ELSE 'New/Unknown' END AS seller_health,
               {ladder("categories", v.DIVERSITY_TYPE)} AS product_diversity_type,
               CASE WHEN same_state_order_rate >= 80 THEN 'Local Focused' WHEN same_state_order_rate >= 50 THEN 'Regional'
                    WHEN states >= 15 THEN 'National' ELSE 'Multi-Regional' END AS geographic_focus
        FROM wide""",
}

CTE = {**RAW, **STAGING, **INTERMEDIATE, **FACTS, **DIMENSIONS, **MARTS}


def _needs(text: str) -> list[str]:
    words = set(re.findall(r"\w+", text))
    return [name for name in CTE if name in words]


def statement(final: str) -> str:
    """A full statement: the common table expressions a final SELECT reads, in order."""
    wanted: set[str] = set()
    queue = _needs(final)
    while queue:
        name = queue.pop()
        if name not in wanted:
            wanted.add(name)
            queue += _needs(CTE[name])
    parts = [f"{name} AS MATERIALIZED ({CTE[name].strip()})" for name in CTE if name in wanted]
    body = final.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def model(name: str) -> str:
    """A model with its columns in comparable form."""
    kinds = COLUMN_KINDS.get(name, {})
    shaped = [
        *[num(c) for c in kinds.get("numbers", "").split()],
        *[day(c) for c in kinds.get("days", "").split()],
        *[moment(c) for c in kinds.get("moments", "").split()],
    ]
    replace = f" REPLACE ({', '.join(shaped)})" if shaped else ""
    return statement(f"SELECT *{replace} FROM {name}")


# which columns of a model are fractional numbers, days or moments
COLUMN_KINDS: dict[str, dict[str, str]] = {
    "stg_orders": {
        "numbers": "hours_to_approval days_to_delivery days_vs_estimated",
        "days": "order_date order_month order_year",
        "moments": """
            order_purchase_timestamp order_approved_at order_delivered_carrier_date
            order_delivered_customer_date order_estimated_delivery_date
        """,
    },
    "stg_order_items": {
        "numbers": "price freight_value total_item_value item_revenue freight_revenue",
        "moments": "shipping_limit_date",
    },
    "stg_payments": {
        "numbers": "payment_value",
    },
    "stg_reviews": {
        "moments": "review_creation_date review_answer_timestamp",
    },
    "stg_products": {
        "numbers": "product_weight_g product_length_cm product_height_cm product_width_cm product_volume_cm3",
    },
    "stg_geolocation": {
        "numbers": "geolocation_lat geolocation_lng",
    },
    "int_orders_enriched": {
        "numbers": "hours_to_approval days_to_delivery days_vs_estimated",
        "days": "order_date order_month order_year",
        "moments": """
            order_purchase_timestamp order_approved_at order_delivered_carrier_date
            order_delivered_customer_date order_estimated_delivery_date review_creation_date
        """,
    },
    "int_order_items_enriched": {
        "numbers": """
            price freight_value total_item_value item_revenue freight_revenue product_weight_g
            product_length_cm product_height_cm product_width_cm product_volume_cm3
        """,
        "moments": "shipping_limit_date",
    },
    "int_order_payments_aggregated": {
        "numbers": """
            total_payment_value avg_installments credit_card_value boleto_value voucher_value
            debit_card_value
        """,
    },
    "fct_orders": {
        "numbers": """
            hours_to_approval days_to_delivery days_vs_estimated total_item_price total_freight
            total_order_value avg_item_price total_payment_value payment_order_diff
        """,
        "days": "order_date order_month order_year",
        "moments": """
            order_purchase_timestamp order_approved_at order_delivered_carrier_date
            order_delivered_customer_date order_estimated_delivery_date
        """,
    },
    "fct_order_items": {
        "numbers": """
            item_price freight_value total_item_value product_weight_g product_length_cm
            product_height_cm product_width_cm product_volume_cm3 freight_percentage
        """,
        "moments": """
            shipping_limit_date order_purchase_timestamp order_delivered_customer_date
            order_estimated_delivery_date
        """,
    },
    "fct_payments": {
        "numbers": "payment_value installment_value",
        "moments": "order_purchase_timestamp",
    },
    "fct_reviews": {
        "numbers": "order_value",
        "moments": """
            review_creation_date review_answer_timestamp order_purchase_timestamp
            order_delivered_customer_date
        """,
    },
    "dim_customers": {
        "numbers": "avg_review_score",
        "moments": "first_order_date last_order_date",
    },
    "dim_products": {
        "numbers": """
            product_weight_g product_length_cm product_height_cm product_width_cm product_volume_cm3
            total_revenue avg_price min_price max_price total_freight avg_freight
        """,
    },
    "dim_sellers": {
        "numbers": """
            total_revenue avg_item_price total_freight avg_freight avg_review_score
            positive_review_rate avg_delivery_days on_time_delivery_rate
        """,
        "moments": "first_sale_date last_sale_date",
    },
    "dim_category": {
        "numbers": """
            total_revenue avg_item_price min_item_price max_item_price total_freight avg_freight
            revenue_per_product
        """,
    },
    "dim_geography": {
        "numbers": "latitude longitude",
    },
    "dim_date": {
        "days": "date_day",
    },
    "mart_customer_analytics": {
        "numbers": """
            lifetime_value avg_order_value avg_items_per_order total_freight avg_freight_per_order
            monetary_value avg_days_between_orders avg_max_installments avg_delivery_days
            on_time_delivery_rate avg_review_score
        """,
        "moments": "first_order_date last_order_date",
    },
    "mart_executive_dashboard": {
        "numbers": """
            total_revenue total_freight total_payments avg_order_value avg_items_per_order
            avg_review_score avg_delivery_days delivery_rate cancellation_rate positive_review_rate
            on_time_delivery_rate installment_usage_rate revenue_per_customer ma7_orders ma7_revenue
            ma7_review_score ma30_orders ma30_revenue ytd_revenue
        """,
        "days": "date_day",
    },
    "mart_executive_dashboard_fanout_safe": {
        "numbers": """
            total_revenue total_freight total_payments avg_order_value avg_items_per_order
            avg_review_score avg_delivery_days delivery_rate cancellation_rate positive_review_rate
            on_time_delivery_rate installment_usage_rate revenue_per_customer ma7_orders ma7_revenue
            ma7_review_score ma30_orders ma30_revenue ytd_revenue
        """,
        "days": "date_day",
    },
    "mart_product_performance": {
        "numbers": """
            product_weight_g product_length_cm product_height_cm product_width_cm product_volume_cm3
            total_revenue avg_price min_price max_price total_freight avg_freight
            avg_freight_percentage delivery_rate cancellation_rate on_time_delivery_rate
            avg_delivery_days same_state_sales_rate avg_review_score positive_review_rate
            avg_days_to_review performance_score revenue_per_unit
        """,
        "moments": "first_sale_date last_sale_date",
    },
    "mart_seller_scorecard": {
        "numbers": """
            total_revenue avg_item_price total_freight avg_freight avg_product_price
            min_product_price max_product_price price_stddev avg_freight_percentage
            same_state_order_rate avg_review_score positive_review_rate avg_delivery_days
            on_time_delivery_rate revenue_per_item revenue_per_order revenue_per_day_active
            revenue_per_month revenue_percentile review_score_100 delivery_score_100
            overall_performance_score
        """,
        "moments": "first_sale_date last_sale_date",
    },
}
