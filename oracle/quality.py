"""SQL for the data checks, the profile and the run history."""

from __future__ import annotations

from bazarlytics.functions import values as v
from bazarlytics.quality import suite
from bazarlytics.sources.retail import EVENT_MODELS
from oracle.sql import day, listing, moment, num, pct, quote, whole
from oracle.warehouse import statement

AS_OF = "2001-12-31"
_DELIVERED = "order_delivered_customer_date"


def _bounds(column: str, low, high) -> str:
    parts = [f"{column} < {quote(low)}"] if low is not None else []
    parts += [f"{column} > {quote(high)}"] if high is not None else []
    return " OR ".join(parts)


def _column_order(expected: list[str]) -> str:
    """Places at which the columns of dim_category, read from one of its rows, are not the expected."""
    return f"""
        SELECT CAST(i AS INTEGER) AS position, e AS expected, a AS actual
        FROM (SELECT unnest({listing(expected).replace("(", "[").replace(")", "]")}) AS e, unnest(range(1, {len(expected) + 1})) AS i) x
        FULL JOIN (SELECT unnest(k) AS a, unnest(range(1, len(k) + 1)) AS i
            FROM (SELECT json_keys(to_json(c)) AS k FROM dim_category c LIMIT 1)) y USING (i)
        WHERE e IS DISTINCT FROM a"""


def _counts() -> list[tuple[str, str, str]]:
    """(check, severity, SQL for the number of failures) of the whole suite."""
    out: list[tuple[str, str]] = []
    for table, columns in suite.NOT_NULL.items():
        out += [(f"not_null_{table}_{c}", f"SELECT count(*) - count({c}) FROM {table}") for c in columns.split()]
    for table, keys in suite.UNIQUE.items():
        for key in keys:
            k = ", ".join(key.split())
            known = " AND ".join(f"{x} IS NOT NULL" for x in key.split())
            out.append((
                f"unique_{table}_{'_'.join(key.split())}",
                f"SELECT count(*) FROM (SELECT {k} FROM {table} WHERE {known} GROUP BY {k} HAVING count(*) > 1)",
            ))
    for table, column, parent, field in suite.RELATIONSHIPS:
        out.append((
            f"relationships_{table}_{column}",
            f"SELECT count(*) FROM {table} x WHERE x.{column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} y WHERE y.{field} = x.{column})",
        ))
    for table, column, allowed in suite.ACCEPTED_VALUES:
        out.append((f"accepted_values_{table}_{column}", f"SELECT count(*) FROM {table} WHERE {column} NOT IN {listing(allowed)}"))
    for table, column, low, high in suite.ACCEPTED_RANGES:
        out.append((f"accepted_range_{table}_{column}", f"SELECT count(*) FROM {table} WHERE {_bounds(column, low, high)}"))
    for table, column, low, high, _ in suite.VALUES_BETWEEN:
        out.append((f"values_between_{table}_{column}", f"SELECT count(*) FROM {table} WHERE {_bounds(column, low, high)}"))
    first, last = suite.PURCHASE_YEARS
    out.append((
        "values_between_stg_orders_order_purchase_timestamp",
        f"SELECT count(*) FROM stg_orders WHERE order_purchase_timestamp < TIMESTAMP '{first}' OR order_purchase_timestamp > TIMESTAMP '{last}'",
    ))
    for table, column, allowed in suite.VALUES_IN_SET:
        out.append((f"values_in_set_{table}_{column}", f"SELECT count(*) FROM {table} WHERE {column} NOT IN {listing(allowed)}"))
    for table, (low, high) in suite.ROW_COUNTS.items():
        out.append((f"row_count_{table}", f"SELECT if(count(*) BETWEEN {low} AND {high}, 0, 1) FROM {table}"))
    for table, column in suite.AT_LEAST_ONE.items():
        out.append((f"at_least_one_{table}_{column}", f"SELECT if(count({column}) > 0, 0, 1) FROM {table}"))
    out += [
        ("expression_fct_order_items_total_value", "SELECT count(*) FROM fct_order_items WHERE total_item_value <> item_price + freight_value"),
        (
            "expression_fct_payments_installment_value",
            "SELECT count(*) FROM fct_payments WHERE abs(installment_value - coalesce(payment_value / nullif(payment_installments, 0), payment_value)) >= 0.0001",
        ),
        ("expression_dim_date_date_key_format", "SELECT count(*) FROM dim_date WHERE CAST(date_key AS VARCHAR) <> replace(CAST(date_day AS VARCHAR), '-', '')"),
        ("expression_mart_executive_dashboard_revenue_not_negative", "SELECT count(*) FROM mart_executive_dashboard WHERE total_revenue < 0"),
        ("pair_ordered_fct_reviews_review_date_key_order_date_key", "SELECT count(*) FROM fct_reviews WHERE review_date_key < order_date_key"),
        (
            "recency_raw_orders_order_purchase_timestamp",
            f"SELECT if(date_diff('day', max(order_purchase_timestamp), DATE '{AS_OF}') > 730, 1, 0) FROM raw_orders",
        ),
    ]
    out.append((
        "column_order_dim_category",
        f"SELECT count(*) FROM ({_column_order(suite.CATEGORY_COLUMNS)})",
    ))
    for table, column in suite.TEXT_COLUMNS:
        out.append((f"column_type_{table}_{column}", f"SELECT count(*) FROM (SELECT any_value(typeof({column})) AS t FROM {table}) WHERE t <> 'VARCHAR'"))
    declared = [(name, "warn", sql) for name, sql in out]
    rules = [
        (name, "error" if name == "orders_without_customer" else "warn", f"SELECT count(*) FROM ({sql})")
        for name, sql in BUSINESS.items()
    ]
    return declared + rules


def _reconcile(key: str, dimension: str) -> str:
    return f"""
        SELECT {key}, fact_total_orders, dim_total_orders, fact_total_items, dim_total_items, {num("fact_total_revenue")}, {num("dim_total_revenue")},
               CASE WHEN fact_total_orders <> dim_total_orders THEN 'Orders mismatch' WHEN fact_total_items <> dim_total_items THEN 'Items mismatch'
                    WHEN abs(fact_total_revenue - dim_total_revenue) > 0.01 THEN 'Revenue mismatch' ELSE 'Unknown mismatch' END AS issue_type
        FROM (SELECT {key}, count(DISTINCT order_id) AS fact_total_orders, count(*) AS fact_total_items, sum(item_price) AS fact_total_revenue
              FROM fct_order_items WHERE {key} IS NOT NULL GROUP BY {key}) f
        JOIN (SELECT {key}, total_orders AS dim_total_orders, total_items_sold AS dim_total_items, total_revenue AS dim_total_revenue FROM {dimension}) d USING ({key})
        WHERE fact_total_orders <> dim_total_orders OR fact_total_items <> dim_total_items OR abs(fact_total_revenue - dim_total_revenue) > 0.01"""


BUSINESS = {
    "orders_without_customer": "SELECT order_id, 'Missing customer_id' AS issue FROM fct_orders WHERE customer_id IS NULL",
    "category_metrics": _reconcile("product_category_name", "dim_category"),
    "seller_metrics": _reconcile("seller_id", "dim_sellers"),
    "missing_date_keys": """
        SELECT * FROM (SELECT order_date_key AS date_key, 'fct_order_items' AS source_table FROM fct_order_items
            UNION SELECT order_date_key, 'fct_payments' FROM fct_payments UNION SELECT review_date_key, 'fct_reviews' FROM fct_reviews
            UNION SELECT order_date_key, 'fct_reviews' FROM fct_reviews) k
        WHERE date_key IS NOT NULL AND date_key NOT IN (SELECT date_key FROM dim_date)""",
    "delivery_dates_out_of_order": f"""
        SELECT DISTINCT order_id, {moment("order_purchase_timestamp")}, {moment("order_approved_at")}, {moment(_DELIVERED)},
               {moment("order_estimated_delivery_date")},
               CASE WHEN s.order_approved_at < s.order_purchase_timestamp THEN 'Approved before purchase'
                    WHEN s.{_DELIVERED} < s.order_purchase_timestamp THEN 'Delivered before purchase'
                    ELSE 'Delivered before approval' END AS issue_type
        FROM stg_orders s WHERE order_status = 'delivered' AND s.{_DELIVERED} IS NOT NULL
          AND (s.order_approved_at < s.order_purchase_timestamp OR s.{_DELIVERED} < s.order_purchase_timestamp OR s.{_DELIVERED} < s.order_approved_at)""",
    "geography_without_entities": """
        SELECT zip_code_prefix, city, state, customer_count, seller_count, total_entities, location_type FROM dim_geography
        WHERE total_entities = 0 OR customer_count + seller_count = 0
           OR location_type <> CASE WHEN customer_count = 0 THEN 'Seller Only' WHEN seller_count = 0 THEN 'Customer Only' ELSE 'Both' END""",
    "negative_values": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, {k} AS record_id, '{c}' AS column_name, {num(c, 'value')} FROM {t} WHERE {c} < 0"
        for t, k, c in (
            ("fct_order_items", "order_id", "item_price"), ("fct_order_items", "order_id", "freight_value"),
            ("fct_payments", "order_id", "payment_value"), ("dim_sellers", "seller_id", "total_revenue"),
            ("dim_category", "product_category_name", "total_revenue"), ("dim_products", "product_id", "total_revenue"),
        )
    ),
    "items_against_payments": f"""
        SELECT order_id, {num("a", "total_items")}, {num("b", "total_payments")}, {num("abs(a - b)", "difference")}
        FROM (SELECT order_id, sum(total_item_value) AS a FROM fct_order_items GROUP BY order_id) i
        FULL JOIN (SELECT order_id, sum(payment_value) AS b FROM fct_payments GROUP BY order_id) p USING (order_id) WHERE abs(a - b) > 0.01""",
    "product_categories": """
        SELECT product_id, f.c AS fact_category, d.c AS dim_category
        FROM (SELECT DISTINCT product_id, product_category_name AS c FROM fct_order_items WHERE product_category_name IS NOT NULL) f
        FULL JOIN (SELECT DISTINCT product_id, product_category_name AS c FROM dim_products WHERE product_category_name IS NOT NULL) d USING (product_id)
        WHERE f.c IS DISTINCT FROM d.c""",
    "reviews_before_purchase": f"""
        SELECT review_id, order_id, {moment("r.review_creation_date", "review_creation_date")},
               {moment("o.order_purchase_timestamp", "order_purchase_timestamp")},
               date_diff('day', o.order_purchase_timestamp, r.review_creation_date) AS days_difference
        FROM fct_reviews r JOIN stg_orders o USING (order_id) WHERE r.review_creation_date < o.order_purchase_timestamp""",
    "sentiment_mismatch": """
        SELECT * FROM (SELECT review_id, order_id, review_score, review_sentiment,
            CASE WHEN review_score > 3 THEN 'positive' WHEN review_score = 3 THEN 'neutral' ELSE 'negative' END AS expected_sentiment FROM fct_reviews) r
        WHERE review_sentiment <> expected_sentiment""",
    "reviews_of_unfulfilled_orders": """
        SELECT review_id, order_id, o.order_status FROM fct_reviews LEFT JOIN stg_orders o USING (order_id)
        WHERE coalesce(o.order_status, '') NOT IN ('delivered', 'shipped', 'canceled')""",
    "order_payment_mismatch": f"""
        SELECT order_id, {num("total_order_value")}, {num("total_payment_value")},
               {num("abs(o.total_order_value - o.total_payment_value)", "difference")}, 'Order/Payment mismatch' AS issue
        FROM fct_orders o WHERE abs(o.total_order_value - o.total_payment_value) > 0.5 AND least(o.total_order_value, o.total_payment_value) > 0""",
    "invalid_scores": "SELECT order_id, review_score, 'Invalid review score' AS issue FROM fct_orders WHERE review_score NOT BETWEEN 1 AND 5",
    "orders_without_items": """
        SELECT order_id, item_count, 'Order with no items' AS issue FROM fct_orders
        WHERE item_count = 0 AND order_status NOT IN ('canceled', 'unavailable')""",
    "performance_mismatch": f"""
        SELECT order_id, delivery_performance, {num("days_vs_estimated")}, 'Incorrect delivery performance' AS issue FROM fct_orders o
        WHERE (delivery_performance = 'early' AND o.days_vs_estimated >= 0) OR (delivery_performance = 'late' AND o.days_vs_estimated <= 0)
           OR (delivery_performance = 'on_time' AND o.days_vs_estimated <> 0)""",
    "executive_revenue": f"""
        SELECT {num("a", "expression")}, {num("b", "compare_expression")}
        FROM (SELECT sum(total_revenue) AS a FROM mart_executive_dashboard_fanout_safe) x, (SELECT sum(total_item_value) AS b FROM fct_order_items) y
        WHERE abs(a - b) > 0.01""",
}

_SUITE = "SELECT name, severity, failures, CASE WHEN failures = 0 THEN 'pass' WHEN severity = 'error' THEN 'fail' ELSE 'warn' END AS status FROM (" + " UNION ALL ".join(
    f"SELECT '{name}' AS name, '{severity}' AS severity, ({sql}) AS failures" for name, severity, sql in _counts()
) + ") s"

CHECKS = {
    "check_not_null": "SELECT product_id FROM stg_products WHERE product_category_name IS NULL",
    "check_unique": "SELECT order_id, count(*) AS occurrences FROM fct_orders GROUP BY order_id HAVING count(*) > 1",
    "check_relationships": """
        SELECT product_id, product_category_name FROM stg_products WHERE product_category_name IS NOT NULL
          AND product_category_name NOT IN (SELECT product_category_name FROM stg_category_translation)""",
    "check_accepted_values": "SELECT order_id, order_status FROM stg_orders WHERE order_status NOT IN ('delivered', 'shipped')",
    "check_accepted_range": f"SELECT review_id, days_delivery_to_review FROM fct_reviews WHERE days_delivery_to_review NOT BETWEEN -30 AND 20",
    "check_row_count": "SELECT true AS failed FROM dim_category HAVING count(*) NOT BETWEEN 50 AND 200",
    "check_values_between": f"""
        SELECT order_id, order_item_id, {num("price")} FROM stg_order_items s WHERE s.price >= 440 AND freight_value IS NOT NULL""",
    "check_at_least_one": "SELECT true AS failed FROM raw_customers HAVING count(customer_id) = 0",
    "check_expression": "SELECT order_id, payment_sequential FROM fct_payments WHERE payment_installments <> 1 AND payment_value >= 700",
    "check_compound_unique": "SELECT order_id, payment_type, count(*) AS occurrences FROM stg_payments GROUP BY ALL HAVING count(*) > 1",
    "check_pair_ordered": "SELECT review_id, review_date_key, order_date_key FROM fct_reviews WHERE review_date_key < order_date_key",
    "check_values_in_set": "SELECT order_id, delivery_performance FROM stg_orders WHERE delivery_performance = 'on_time'",
    "check_aggregate_equals": f"""
        SELECT {num("a", "expression")}, {num("b", "compare_expression")}
        FROM (SELECT sum(total_revenue) AS a FROM mart_executive_dashboard) x, (SELECT sum(total_item_value) AS b FROM fct_order_items) y WHERE abs(a - b) > 0.01""",
    "check_recency": f"""
        SELECT true AS failed FROM raw_orders HAVING date_diff('day', max(order_purchase_timestamp), DATE '{AS_OF}') > 30""",
    "check_invalid_states": f"""
        SELECT state_name AS invalid_state, count(*) AS occurrences FROM dim_geography WHERE state_name NOT IN {listing(v.STATE_NAMES)} GROUP BY ALL""",
    "check_invalid_zips": """
        SELECT customer_zip_code_prefix AS invalid_zip, count(*) AS occurrences FROM raw_customers
        WHERE CAST(customer_zip_code_prefix AS INTEGER) NOT BETWEEN 1000 AND 99999 OR length(customer_zip_code_prefix) <> 5 GROUP BY ALL""",
    "check_invalid_dates": f"""
        SELECT {day("order_date", "invalid_date")}, count(*) AS occurrences FROM stg_orders
        WHERE order_date NOT BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY order_date""",
    "check_invalid_percentages": f"""
        SELECT {num("freight_percentage", "invalid_percentage")}, count(*) AS occurrences FROM fct_order_items
        WHERE freight_percentage NOT BETWEEN 0 AND 100 GROUP BY freight_percentage""",
    **{f"check_{name}": sql for name, sql in BUSINESS.items()},
    "check_freshness": " UNION ALL ".join(
        f"""SELECT '{s}' AS source, age_days, CASE WHEN age_days IS NULL OR age_days > {error} THEN 'error' WHEN age_days > {warn} THEN 'warn' ELSE 'pass' END AS status
            FROM (SELECT date_diff('day', max({c}), DATE '{AS_OF}') AS age_days FROM raw_{s})"""
        for s, c, warn, error in suite.FRESHNESS
    ),
    "check_column_order": _column_order(sorted(suite.CATEGORY_COLUMNS)),
    "check_suite": _SUITE,
    "check_timed": f"SELECT *, true AS timed FROM ({_SUITE}) r",
    "check_status_summary": f"""
        SELECT status, count(*) AS checks, {num("100.0 * count(*) / sum(count(*)) OVER ()", "percentage")} FROM ({_SUITE}) r GROUP BY status""",
    "check_result_totals": f"""
        SELECT count(*) AS checks, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'fail') AS errors,
               count(*) FILTER (status = 'warn') AS warnings, {num(pct("count(*) FILTER (status = 'pass')"), "pass_rate")} FROM ({_SUITE}) r""",
    "check_failing": f"SELECT * FROM ({_SUITE}) r WHERE status <> 'pass'",
}

_CORE = [
    "fct_orders", "fct_order_items", "fct_payments", "fct_reviews", "dim_customers", "dim_products", "dim_sellers", "dim_category",
    "dim_geography", "dim_date",
]

PROFILE = {
    "profile_table_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in _CORE),
    "profile_coverage": f"""
        SELECT count(*) AS total_orders, count(*) FILTER (total_payment_value > 0) AS with_payment, count(review_score) AS with_review,
               count(*) FILTER (is_delivered) AS delivered, {num("avg(total_order_value) FILTER (total_order_value > 0)", "avg_order_value")},
               {num(pct("count(*) FILTER (total_payment_value > 0)"), "with_payment_pct")},
               {num(pct("count(review_score)"), "with_review_pct")}, {num(pct("count(*) FILTER (is_delivered)"), "delivered_pct")} FROM fct_orders""",
    "profile_status_mix": f"""
        SELECT order_status, count(*) AS count, {num("100.0 * count(*) / sum(count(*)) OVER ()", "percentage")} FROM fct_orders GROUP BY order_status""",
    "profile_segment_mix": f"""
        SELECT customer_segment, count(*) AS count, {num("100.0 * count(*) / sum(count(*)) OVER ()", "percentage")} FROM dim_customers GROUP BY 1""",
    "profile_sentiment_mix": f"""
        SELECT review_sentiment, count(*) AS count, {num("avg(review_score)", "avg_score")} FROM fct_orders WHERE review_sentiment IS NOT NULL GROUP BY 1""",
    "profile_busiest_states": f"""
        SELECT customer_state, count(*) AS orders, {num("sum(total_order_value)", "total_value")}, {num("avg(total_order_value)", "avg_value")}
        FROM fct_orders WHERE customer_state IS NOT NULL GROUP BY customer_state ORDER BY count(*) DESC, customer_state LIMIT 5""",
}

RUN_DAY = "2024-01-31"
_NAMES = "[" + ", ".join(quote(m) for m in EVENT_MODELS) + "]"
_HISTORY = f"""
    model_history AS (
        SELECT 'run_' || user_id || strftime(ts, '_%Y%m%d') AS invocation_id, model AS model_name, 'core' AS schema_name,
               CASE left(model, 4) WHEN 'stg_' THEN 'view' WHEN 'int_' THEN 'ephemeral' ELSE 'table' END AS materialization,
               if(event_type = 'error', 'error', 'success') AS status, value AS execution_time_seconds, event_id % 1000 AS rows_affected,
               ts AS executed_at, 'model.shop.' || model || '.' || event_id AS unique_id, user_id
        FROM (SELECT *, {_NAMES}[event_id % {len(EVENT_MODELS)} + 1] AS model FROM events) e),
    run_history AS (
        SELECT invocation_id, min(executed_at) AS run_started_at, max(executed_at) AS run_completed_at, bool_and(status = 'success') AS success,
               count(*) AS total_models, count(*) FILTER (rows_affected < 100) AS total_tests, sum(execution_time_seconds) AS total_runtime_seconds,
               CASE any_value(user_id) % 3 WHEN 0 THEN 'build' WHEN 1 THEN 'run' ELSE 'test' END AS dbt_command, '1.0' AS dbt_version, 'prod' AS target_name
        FROM model_history GROUP BY invocation_id)"""


def _rounded(expr: str, name: str) -> str:
    return f"round({expr}, 2) AS {name}"


def _since(column: str, days: int) -> str:
    return f"{column} >= DATE '{RUN_DAY}' - {days}"


_AVG = _rounded("avg(execution_time_seconds)", "avg_seconds")

HISTORY = {
    "history_models": f"SELECT * EXCLUDE (user_id) REPLACE ({num('execution_time_seconds')}, {moment('executed_at')}) FROM model_history",
    "history_runs": f"""
        SELECT * REPLACE ({num("total_runtime_seconds")}, {moment("run_started_at")}, {moment("run_completed_at")}) FROM run_history""",
    "history_status": f"""
        SELECT 'run_history' AS table_name, count(*) AS row_count, {moment("max(run_started_at)", "latest_record")} FROM run_history
        UNION ALL SELECT 'model_history', count(*), {moment("max(executed_at)", "latest_record")} FROM model_history""",
    "history_latest_totals": f"""
        SELECT {whole("sum(total_models)", "models_run")}, {_rounded("sum(total_runtime_seconds)", "total_runtime_seconds")},
               count(*) FILTER (NOT success) AS failed_runs, {moment("max(run_started_at)", "last_run")} FROM run_history WHERE {_since("run_started_at", 7)}""",
    "history_runtime_trend": f"""
        SELECT {day("run_started_at", "run_date")}, {whole("sum(total_models)", "models_executed")},
               {_rounded("sum(total_runtime_seconds)", "runtime_seconds")} FROM run_history WHERE {_since("run_started_at", 30)} GROUP BY 1""",
    "history_slowest_models": f"""
        SELECT model_name, materialization, {_AVG}, count(*) AS run_count FROM model_history
        WHERE status = 'success' AND {_since("executed_at", 7)} GROUP BY ALL ORDER BY avg_seconds DESC, model_name, materialization LIMIT 15""",
    "history_time_by_layer": f"""
        SELECT CASE regexp_extract(model_name, '^[a-z]+_') WHEN 'stg_' THEN 'staging' WHEN 'int_' THEN 'intermediate' WHEN 'dim_' THEN 'dimension'
                    WHEN 'fct_' THEN 'fact' WHEN 'mart_' THEN 'mart' ELSE 'other' END AS model_layer, count(DISTINCT model_name) AS model_count,
               {_rounded("avg(execution_time_seconds)", "avg_execution_seconds")}, {_rounded("sum(execution_time_seconds)", "total_execution_seconds")}
        FROM model_history WHERE status = 'success' AND {_since("executed_at", 7)} GROUP BY 1""",
    "history_recent_runs": f"""
        SELECT invocation_id, dbt_command, {moment("run_started_at", "run_time")}, {_rounded("total_runtime_seconds", "runtime_sec")}, total_models, success
        FROM run_history ORDER BY run_history.run_started_at DESC, invocation_id LIMIT 10""",
    "history_recent_executions": f"""
        SELECT model_name, materialization, status, {_rounded("execution_time_seconds", "execution_seconds")}, {moment("executed_at")}
        FROM model_history ORDER BY model_history.executed_at DESC, invocation_id, unique_id LIMIT 20""",
    "history_slow_executions": f"""
        SELECT model_name, materialization, {_AVG}, count(*) AS run_count FROM model_history
        WHERE execution_time_seconds > 1 AND status = 'success' GROUP BY ALL""",
    "history_model_over_time": f"""
        SELECT model_name, {day("executed_at", "execution_date")}, {_rounded("avg(execution_time_seconds)", "avg_runtime")}, count(*) AS executions
        FROM model_history WHERE model_name = 'fct_orders' AND {_since("executed_at", 30)} GROUP BY 1, 2""",
    "history_runs_by_command": f"""
        SELECT dbt_command, count(*) AS runs, {_rounded("avg(total_runtime_seconds)", "avg_runtime")},
               count(*) FILTER (success) AS successful_runs, {_rounded(pct("count(*) FILTER (success)"), "success_rate_pct")}
        FROM run_history GROUP BY dbt_command""",
    "history_checks": """
        SELECT name, 'warn' AS severity, failures, if(failures = 0, 'pass', 'warn') AS status FROM (
            SELECT 'expression_run_history_models_not_negative' AS name, count(*) FILTER (total_models < 0) AS failures FROM run_history
            UNION ALL SELECT 'expression_model_history_time_not_negative', count(*) FILTER (execution_time_seconds < 0) FROM model_history) c""",
}

# what the shared log gives back is what was logged
HISTORY |= {"history_logged_runs": HISTORY["history_runs"], "history_logged_models": HISTORY["history_models"]}

STATEMENTS = {
    **{name: statement(sql) for name, sql in {**CHECKS, **PROFILE}.items()},
    **{name: f"WITH {_HISTORY.strip()} {sql.strip()}" for name, sql in HISTORY.items()},
}
