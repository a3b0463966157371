"""Every query by name over a folder of test tables.

A query runs on a warehouse that is built from the folder on first use and stored in the
session's shared folder; the models themselves are computed afresh when they are the query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazarlytics.analyses import (
    activity,
    delivery,
    everyday,
    executive,
    geography,
    product,
    retention,
    revenue,
    rfm,
    risk,
    satisfaction,
    seller,
    sketches,
    timing,
)
from bazarlytics.history import log, runs
from bazarlytics.operators.checksums import differences
from bazarlytics.operators.grouping import union_all
from bazarlytics.plans.incremental import read_orders, refresh_orders
from bazarlytics.plans.warehouse import MODELS, Warehouse, retail_warehouse
from bazarlytics.quality import business, checks, profile, suite
from bazarlytics.session import scratch_path, tune
from bazarlytics.sources import retail

Query = Callable[[Warehouse], DataFrame]

_warehouses: dict[tuple[str, str], Warehouse] = {}


def warehouse(spark: SparkSession, folder: str) -> Warehouse:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _warehouses:
        _warehouses[key] = retail_warehouse(tune(spark), folder, checks=suite.all_checks(AS_OF))
    return _warehouses[key]


def comparable(df: DataFrame) -> DataFrame:
    """Fractions as doubles with four decimals, days and moments as text.

    The nudge makes exact halves round alike in every engine.
    """
    shaped = []
    for field in df.schema:
        kind, column = field.dataType.typeName(), F.col(field.name)
        if kind in ("double", "decimal"):
            column = F.round(column.cast("double") + 1e-7, 4)
        elif kind == "date":
            column = column.cast("string")
        elif kind.startswith("timestamp"):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        shaped.append(column.alias(field.name))
    return df.select(*shaped)


def _bind(query: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: comparable(query(warehouse(spark, folder)))


# a period that holds every order of the test tables
START, END = "1995-01-01", "2001-12-31"


# a period inside the data, for analyses whose results depend on what lies before and after it
BOUNDED = "1996-03-15", "1998-02-10"


def _orders(analysis: Callable[..., DataFrame], start: str = START, end: str = END, **options) -> Query:
    return lambda w: analysis(w["fct_orders"], start=start, end=end, **options)


def _mart(name: str, analysis: Callable[..., DataFrame], **options) -> Query:
    return lambda w: analysis(w[f"mart_{name}"], **options)


def _customers(analysis: Callable[..., DataFrame], **options) -> Query:
    return _mart("customer_analytics", analysis, **options)


def _products(analysis: Callable[..., DataFrame], **options) -> Query:
    return _mart("product_performance", analysis, **options)


def _sellers(analysis: Callable[..., DataFrame], **options) -> Query:
    return _mart("seller_scorecard", analysis, **options)


def model_queries() -> dict[str, Query]:
    return {name: (lambda w, name=name: w.plan(name)) for name in MODELS}


ANALYSES: dict[str, Query] = {
    "q01_executive_kpis": _orders(executive.executive_kpis),
    "q02_revenue_trend": _orders(executive.revenue_trend),
    "q03_customer_acquisition": _orders(executive.customer_acquisition),
    "q04_order_volume": _orders(executive.order_volume),
    "q05_order_value_distribution": _orders(executive.order_value_distribution),
    "q06_delivery_performance": _orders(executive.delivery_performance),
    "q06_delivery_performance_long": _orders(executive.delivery_performance_long),
    "q07_satisfaction_trend": _orders(executive.satisfaction_trend),
    "q08_review_distribution": _orders(executive.review_distribution),
    "q09_payment_mix": _orders(revenue.payment_mix),
    "q10_installments": _orders(revenue.installments),
    "q11_order_value_tiers": _orders(revenue.order_value_tiers),
    "q12_freight_burden": _orders(revenue.freight_burden),
    "q13_seasonality": _orders(revenue.seasonality),
    "q14_lifetime_value": _orders(revenue.lifetime_value),
    "q15_delivery_speed_revenue": _orders(revenue.delivery_speed_revenue),
    "q16_retention_kpis": _orders(retention.retention_kpis),
    "q17_order_count_segments": _orders(retention.order_count_segments),
    "q18_days_to_second_purchase": _orders(retention.days_to_second_purchase),
    "q18_second_purchase_summary": _orders(retention.second_purchase_summary),
    "q18_second_purchase_bins": _orders(retention.second_purchase_bins),
    "q19_cohort_activity": _orders(retention.cohort_activity),
    "q19_cohort_retention": _orders(retention.cohort_retention),
    "q19_cohort_matrix": _orders(retention.cohort_matrix),
    "q19_retention_curve": _orders(retention.retention_curve),
    "q20_monthly_churn": _orders(retention.monthly_churn),
    "q21_review_writers": _orders(retention.review_writers),
    "q22_segment_list": _customers(rfm.segment_list),
    "q23_customer_kpis": _customers(rfm.customer_kpis),
    "q23_customer_kpis_filtered": _customers(
        rfm.customer_kpis, segment="At Risk", lifecycle="Dormant"
    ),
    "q24_segment_summary": _customers(rfm.segment_summary),
    "q25_score_counts": _customers(rfm.score_counts),
    "q26_scores_by_segment": _customers(rfm.scores_by_segment),
    "q27_lifecycle_summary": _customers(rfm.lifecycle_summary),
    "q28_value_tier_summary": _customers(rfm.value_tier_summary),
    "q29_segment_characteristics": _customers(rfm.segment_characteristics),
    "q30_reactivation_targets": _customers(rfm.reactivation_targets),
    "q31_segment_by_region": _customers(rfm.segment_by_region),
    "q32_behavior_patterns": _customers(rfm.behavior_patterns),
    "q33_satisfaction_kpis": _orders(satisfaction.satisfaction_kpis),
    "q33_rating_distribution": _orders(satisfaction.rating_distribution),
    "q34_nps_trend": _orders(satisfaction.nps_trend),
    "q35_rating_by_performance": _orders(satisfaction.rating_by_performance),
    "q36_rating_by_delivery_time": _orders(satisfaction.rating_by_delivery_time),
    "q37_state_satisfaction": _orders(satisfaction.state_satisfaction),
    "q37_state_satisfaction_extremes": _orders(satisfaction.state_satisfaction_extremes),
    "q38_satisfaction_factors": _orders(satisfaction.satisfaction_factors),
    "q38_factors_by_order_value": _orders(satisfaction.factors_by, factor="order_value_segment"),
    "q38_factors_by_payment": _orders(satisfaction.factors_by, factor="primary_payment_method"),
    "q38_factors_by_freight": _orders(satisfaction.factors_by, factor="freight_segment"),
    "q39_delivery_kpis": _orders(delivery.delivery_kpis),
    "q40_delivery_trend": _orders(delivery.delivery_trend),
    "q40_delivery_trend_long": _orders(delivery.delivery_trend_long),
    "q41_state_delivery": _orders(delivery.state_delivery),
    "q41_state_delivery_extremes": _orders(delivery.state_delivery_extremes),
    "q41_latest_states": _orders(delivery.latest_states),
    "q42_satisfaction_by_delivery_time": _orders(delivery.satisfaction_by_delivery_time),
    "q43_satisfaction_by_performance": _orders(delivery.satisfaction_by_performance),
    "q44_freight_and_delivery": _orders(delivery.freight_and_delivery),
    "q45_fulfillment_cycle": _orders(delivery.fulfillment_cycle),
    "q45_fulfillment_cycle_long": _orders(delivery.fulfillment_cycle_long),
    "q46_state_revenue": _orders(geography.state_revenue),
    "q46_top_states_by_revenue": _orders(geography.top_states),
    "q46_top_states_by_unit_economics": _orders(geography.top_states, by="revenue_per_customer"),
    "q47_top_cities": _orders(geography.top_cities),
    "q48_state_growth": _orders(geography.state_growth),
    "q48_fastest_growing_states": _orders(geography.fastest_growing_states),
    "q49_by_day_of_week": _orders(timing.by_day_of_week),
    "q50_by_month_of_year": _orders(timing.by_month_of_year),
    "q51_by_quarter": _orders(timing.by_quarter),
    "q52_by_hour": _orders(timing.by_hour),
    "q52_peaks": _orders(timing.peaks),
    "q53_reactivation_segments": lambda w: timing.reactivation_segments(
        w["dim_customers"], START, END
    ),
    "q54_dormant_value": lambda w: timing.dormant_value(
        w["dim_customers"], w["fct_orders"], START, END
    ),
    "q55_cancellation_kpis": _orders(risk.cancellation_kpis),
    "q56_cancellation_trend": _orders(risk.cancellation_trend),
    "q57_cancellation_by_value": _orders(risk.cancellation_by_value),
    "q58_cancellation_by_state": _orders(risk.cancellation_by_state),
    "q58_riskiest_states": _orders(risk.riskiest_states),
    "q59_cancellation_by_payment": _orders(risk.cancellation_by_payment),
    "q60_installment_distribution": _orders(risk.installment_distribution),
    "q60_installment_distribution_to_12": _orders(
        risk.installment_distribution, max_installments=12
    ),
    "q60_installment_groups": _orders(risk.installment_groups),
    "q61_payment_failure": _orders(risk.payment_failure),
    "q62_payment_failure_by_state": _orders(risk.payment_failure_by_state),
    "q63_category_list": _products(product.category_list),
    "q64_product_kpis": _products(product.product_kpis),
    "q64_product_kpis_filtered": _products(product.product_kpis, category="toys", min_sales=20),
    "q65_top_products": _products(product.top_products),
    "q66_top_categories": _products(product.top_categories),
    "q67_price_and_review": _products(product.price_and_review),
    "q68_sales_tiers": _products(product.sales_tiers),
    "q69_review_tiers": _products(product.review_tiers),
    "q70_delivery_by_category": _products(product.delivery_by_category),
    "q71_geographic_reach": _products(product.geographic_reach),
    "q72_seller_health_list": _sellers(seller.value_list, column="seller_health"),
    "q73_activity_status_list": _sellers(seller.value_list, column="activity_status"),
    "q74_region_list": _sellers(seller.value_list, column="region"),
    "q75_marketplace_kpis": _sellers(seller.marketplace_kpis),
    "q75_marketplace_kpis_filtered": _sellers(
        seller.marketplace_kpis, region="Northeast", health="Needs Improvement", min_orders=10
    ),
    "q76_top_sellers": _sellers(seller.top_sellers),
    "q77_health_distribution": _sellers(seller.health_distribution),
    "q78_activity_distribution": _sellers(seller.activity_distribution),
    "q79_revenue_by_tier": _sellers(seller.revenue_by_tier),
    "q80_top_by_percentile": _sellers(seller.top_by_percentile),
    "q80_percentile_histogram": _sellers(seller.percentile_histogram),
    "q81_specialization": _sellers(seller.specialization),
    "q82_region_summary": _sellers(seller.region_summary),
    "q83_geographic_focus": _sellers(seller.geographic_focus),
    "q84_delivery_and_review": _sellers(seller.delivery_and_review),
    "everyday_revenue_by_month": lambda w: everyday.revenue_by_month(
        w["stg_orders"], w["stg_order_items"]
    ),
    "everyday_top_categories": lambda w: everyday.top_sold_categories(w["fct_order_items"]),
    "everyday_score_distribution": lambda w: everyday.score_distribution(w["stg_reviews"]),
    "everyday_daily_revenue": lambda w: everyday.daily_revenue(
        w["fct_order_items"], w["dim_date"]
    ),
}

ANALYSES |= {
    f"{name}_bounded": _orders(analysis, *BOUNDED)
    for name, analysis in {
        "q01_executive_kpis": executive.executive_kpis,
        "q02_revenue_trend": executive.revenue_trend,
        "q03_customer_acquisition": executive.customer_acquisition,
        "q18_days_to_second_purchase": retention.days_to_second_purchase,
        "q19_cohort_activity": retention.cohort_activity,
        "q19_cohort_retention": retention.cohort_retention,
        "q20_monthly_churn": retention.monthly_churn,
        "q46_state_revenue": geography.state_revenue,
        "q48_state_growth": geography.state_growth,
        "q55_cancellation_kpis": risk.cancellation_kpis,
    }.items()
}


AS_OF = "2001-12-31"
CORE_TABLES = [
    "fct_orders", "fct_order_items", "fct_payments", "fct_reviews", "dim_customers",
    "dim_products", "dim_sellers", "dim_category", "dim_geography", "dim_date",
]
RUN_DAY = "2024-01-31"


def _suite(w: Warehouse) -> DataFrame:
    return checks.run_checks(suite.all_checks(AS_OF), w)


def _suite_results(w: Warehouse) -> DataFrame:
    """The suite's result table, stored once and read by the summaries."""
    return w.stored("check_results", _suite)


def _failing(check: checks.Check, *columns: str) -> Query:
    return lambda w: check.failing(w).select(*columns) if columns else check.failing(w)


CHECKS: dict[str, Query] = {
    "check_not_null": _failing(
        checks.not_null("stg_products", "product_category_name"), "product_id"
    ),
    "check_unique": _failing(checks.unique("fct_orders", "order_id")),
    "check_relationships": _failing(
        checks.relationships(
            "stg_products", "product_category_name", "stg_category_translation",
            "product_category_name",
        ),
        "product_id", "product_category_name",
    ),
    "check_accepted_values": _failing(
        checks.accepted_values("stg_orders", "order_status", ["delivered", "shipped"]),
        "order_id", "order_status",
    ),
    "check_accepted_range": _failing(
        checks.accepted_range("fct_reviews", "days_delivery_to_review", -30, 20),
        "review_id", "days_delivery_to_review",
    ),
    "check_row_count": _failing(checks.row_count_between("dim_category", 50, 200)),
    "check_values_between": _failing(
        checks.values_between(
            "stg_order_items", "price", 0, 440, strictly=True, where="freight_value is not null"
        ),
        "order_id", "order_item_id", "price",
    ),
    "check_at_least_one": _failing(checks.at_least_one("raw_customers", "customer_id")),
    "check_expression": _failing(
        checks.expression_is_true(
            "fct_payments", "dear_in_one_part", "payment_installments = 1 or payment_value < 700"
        ),
        "order_id", "payment_sequential",
    ),
    "check_compound_unique": _failing(checks.unique("stg_payments", "order_id", "payment_type")),
    "check_pair_ordered": _failing(
        checks.pair_ordered("fct_reviews", "review_date_key", "order_date_key"),
        "review_id", "review_date_key", "order_date_key",
    ),
    "check_values_in_set": _failing(
        checks.values_in_set(
            "stg_orders", "delivery_performance", ["early", "late"],
            where="delivery_performance is not null",
        ),
        "order_id", "delivery_performance",
    ),
    "check_aggregate_equals": lambda w: business.executive_revenue(w, "mart_executive_dashboard"),
    "check_recency": _failing(
        checks.recency("raw_orders", "order_purchase_timestamp", 30, AS_OF)
    ),
    "check_invalid_states": lambda w: checks.invalid_states(w["dim_geography"], "state_name"),
    "check_invalid_zips": lambda w: checks.invalid_zip_prefixes(
        w["raw_customers"], "customer_zip_code_prefix"
    ),
    "check_invalid_dates": lambda w: checks.invalid_dates(
        w["stg_orders"], "order_date", "1996-01-01", "2000-12-31"
    ),
    "check_invalid_percentages": lambda w: checks.invalid_percentages(
        w["fct_order_items"], "freight_percentage"
    ),
    **{f"check_{c.name}": c.failing for c in business.business_checks()},
    "check_column_order": lambda w: checks.columns_match(
        w["dim_category"], sorted(suite.CATEGORY_COLUMNS)
    ),
    # seconds differ from run to run: only that every check has them can be compared
    "check_timed": lambda w: checks.timed_checks(suite.all_checks(AS_OF), w).select(
        "name", "severity", "failures", "status", (F.col("seconds") > 0).alias("timed")
    ),
    "check_freshness": lambda w: union_all(
        [
            checks.freshness(w[f"raw_{source}"], source, column, warn, error, AS_OF)
            for source, column, warn, error in suite.FRESHNESS
        ],
    ),
    "check_suite": _suite,
    "check_status_summary": lambda w: profile.status_summary(_suite_results(w)),
    "check_result_totals": lambda w: profile.result_totals(_suite_results(w)),
    "check_failing": lambda w: profile.failing_checks(_suite_results(w)),
    "profile_table_counts": lambda w: profile.table_counts(w, CORE_TABLES),
    "profile_coverage": lambda w: profile.coverage(w["fct_orders"]),
    "profile_status_mix": lambda w: profile.label_mix(w["fct_orders"], "order_status"),
    "profile_segment_mix": lambda w: profile.label_mix(w["dim_customers"], "customer_segment"),
    "profile_sentiment_mix": lambda w: profile.sentiment_mix(w["fct_orders"]),
    "profile_busiest_states": lambda w: profile.busiest_states(w["fct_orders"]),
}



def _activity(analysis: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda w: analysis(
        w.stored("customer_activity", lambda w: activity.customer_activity(w["fct_orders"]))
    )


ACTIVITY: dict[str, Query] = {
    "activity_cohorts": _activity(activity.cohort_activity),
    "activity_churn": _activity(activity.monthly_churn),
    "activity_active_months": _activity(activity.active_months),
    "activity_kept_between": _activity(activity.kept_between),
}


def _sketched_months(w: Warehouse) -> DataFrame:
    daily = w.stored("daily_sketches", lambda w: sketches.daily_sketches(w["fct_orders"]))
    return sketches.checked_months(daily, w["fct_orders"])


SKETCHES: dict[str, Query] = {"sketch_monthly_orders": _sketched_months}

# an older state of the shop: one month of orders is not there yet, another lacks its payments
LATE_ORDERS, LATE_PAYMENTS = "1997-05-01", "1996-03-01"
_INPUTS = ("stg_orders", "stg_customers", "stg_reviews", "stg_payments", "stg_order_items")


def _refreshed(w: Warehouse, *states: str) -> DataFrame:
    """The order fact after refreshes from the given states of the shop, older or now."""
    path = scratch_path(w.spark, "refreshed_orders")
    orders, customers, reviews, payments, items = (w[name] for name in _INPUTS)
    unpaid = orders.where(F.col("order_month") == LATE_PAYMENTS).select("order_id").distinct()
    for state in states:
        if state == "older":
            known = orders.where(F.col("order_month") != LATE_ORDERS)
            paid = payments.join(unpaid, "order_id", "left_anti")
            refresh_orders(path, known, customers, reviews, paid, items)
        else:
            refresh_orders(path, orders, customers, reviews, payments, items)
    return read_orders(w.spark, path, w.plan("fct_orders"))


def _dashboards_apart(w: Warehouse) -> DataFrame:
    sides = [
        w[f"mart_executive_dashboard{kind}"].select(
            F.trunc("date_day", "month").alias("month"), "date_day", "total_orders",
            F.col("total_revenue").cast("decimal(18,2)").alias("total_revenue"),
        )
        for kind in ("", "_fanout_safe")
    ]
    return differences(*sides, key=["date_day"], part="month")


INCREMENTAL: dict[str, Query] = {
    "incremental_fct_orders": lambda w: _refreshed(w, "older", "now"),
    "reconcile_older_orders": lambda w: differences(
        _refreshed(w, "older"), w["fct_orders"], ["order_id"], "order_month"
    ),
    "reconcile_dashboards": _dashboards_apart,
}

History = Callable[[DataFrame, DataFrame], DataFrame]


def _logged(r: DataFrame, m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The history as the log gives it back: three entries by day of the month, the first two
    of them compacted before the third comes."""
    spark, folder, day = r.sparkSession, scratch_path(r.sparkSession, "run-log"), F.day("run_started_at")
    last = F.coalesce(day > 20, F.lit(True))
    for number, some in enumerate((~last & (day <= 10), ~last & (day > 10), last)):
        part = r.where(some)
        log.log_rows(part, m.join(part.select("invocation_id").distinct(), "invocation_id", "left_semi"), folder)
        if number == 1:
            log.compact(spark, folder)
    return log.read_log(spark, folder)


# reports over (runs, models)
HISTORY: dict[str, History] = {
    "history_models": lambda r, m: m,
    "history_runs": lambda r, m: r,
    "history_status": lambda r, m: runs.history_status(r, m),
    "history_latest_totals": lambda r, m: runs.latest_totals(r, RUN_DAY),
    "history_runtime_trend": lambda r, m: runs.runtime_trend(r, RUN_DAY),
    "history_slowest_models": lambda r, m: runs.slowest_models(m, RUN_DAY),
    "history_time_by_layer": lambda r, m: runs.time_by_layer(m, RUN_DAY),
    "history_recent_runs": lambda r, m: runs.recent_runs(r),
    "history_recent_executions": lambda r, m: runs.recent_executions(m),
    "history_slow_executions": lambda r, m: runs.slow_executions(m),
    "history_model_over_time": lambda r, m: runs.model_over_time(m, "fct_orders", RUN_DAY),
    "history_runs_by_command": lambda r, m: runs.runs_by_command(r),
    "history_logged_runs": lambda r, m: _logged(r, m)[0],
    "history_logged_models": lambda r, m: _logged(r, m)[1],
    "history_checks": lambda r, m: checks.run_checks(
        suite.history_checks(), {"run_history": r, "model_history": m}
    ),
}


def _bind_history(report: History) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        tune(spark)
        return comparable(
            report(retail.run_history(spark, folder), retail.model_history(spark, folder))
        )

    return run


def plain_queries() -> dict[str, Query]:
    return {**model_queries(), **ANALYSES, **CHECKS, **ACTIVITY, **SKETCHES, **INCREMENTAL}


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        **{name: _bind(query) for name, query in plain_queries().items()},
        **{name: _bind_history(report) for name, report in HISTORY.items()},
    }


def oracle_statements() -> dict[str, str]:
    from oracle import analyses, quality
    from oracle.warehouse import model

    return {
        **{name: model(name) for name in MODELS},
        **analyses.STATEMENTS,
        **quality.STATEMENTS,
        "incremental_fct_orders": model("fct_orders"),
    }
