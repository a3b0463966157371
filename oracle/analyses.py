"""SQL for the analyses, each a final SELECT over the warehouse models."""

from __future__ import annotations

from bazarlytics.functions import values as v
from oracle.sql import day, ladder, num, pct, quote, whole
from oracle.warehouse import statement

START, END = "1995-01-01", "2001-12-31"
_PERIOD = f"order_date BETWEEN DATE '{START}' AND DATE '{END}'"
_DONE = f"FROM fct_orders WHERE is_delivered AND {_PERIOD}"
_ALL = f"FROM fct_orders WHERE {_PERIOD}"
_MONTH = day("order_month", "month")


def share(condition: str, name: str) -> str:
    return num(pct(f"count(*) FILTER ({condition})"), name)


def avg(column: str, name: str | None = None) -> str:
    return num(f"avg({column})", name or f"avg_{column}")


def _orders(name: str = "total_orders") -> str:
    return f"count(*) AS {name}"


_REV = num("sum(total_order_value)", "total_revenue")
_AOV = avg("total_order_value", "avg_order_value")
_RATING = avg("review_score", "avg_rating")
_SAT = avg("review_score", "avg_satisfaction")
_DAYS = avg("days_to_delivery", "avg_delivery_days")
_VS = avg("days_vs_estimated")
_EARLY = share("delivery_performance = 'early'", "early_pct")
_ONTIME = share("delivery_performance = 'on_time'", "ontime_pct")
_LATE = share("delivery_performance = 'late'", "late_pct")
_PRO = share("review_score > 3", "promoters_pct")
_CON = share("review_score < 3", "detractors_pct")
_NPS = num("100.0 * (count(*) FILTER (review_score > 3) - count(*) FILTER (review_score < 3)) / count(*)", "nps")
_CANCEL = f"count(*) AS total_orders, count(*) FILTER (is_canceled) AS canceled_orders, {share('is_canceled', 'cancellation_rate')}"


def _tier(column: str, steps: v.Ladder, name: str) -> str:
    return f"{ladder(column, steps)} AS {name}"


EXECUTIVE = {
    "q01_executive_kpis": f"""
        WITH firsts AS (SELECT customer_id, min(order_date) AS first_day FROM fct_orders GROUP BY customer_id)
        SELECT {num("sum(total_order_value)", "total_gmv")}, {_orders()}, {_AOV}, count(DISTINCT customer_id) AS total_customers,
               count(DISTINCT customer_id) FILTER (order_date = first_day) AS new_customers, {_DAYS}, {_VS},
               {share("delivery_performance = 'late'", "late_delivery_pct")}, {avg("review_score", "avg_satisfaction_score")},
               {share("is_positive_review", "positive_review_pct")}
        FROM fct_orders JOIN firsts USING (customer_id) WHERE is_delivered AND {_PERIOD}""",
    "q02_revenue_trend": f"""
        WITH months AS (
            SELECT order_month, count(*) AS n, CAST(sum(total_order_value) AS DOUBLE) AS revenue, avg(total_order_value) AS aov,
                   count(DISTINCT customer_id) AS people {_DONE} GROUP BY order_month)
        SELECT {_MONTH}, n AS total_orders, {num("revenue", "monthly_revenue")}, {num("aov", "avg_order_value")}, people AS active_customers,
               {num("100 * (revenue / lag(revenue) OVER (ORDER BY order_month) - 1)", "mom_growth")},
               {num("100 * (revenue / lag(revenue, 12) OVER (ORDER BY order_month) - 1)", "yoy_growth")}
        FROM months""",
    "q03_customer_acquisition": f"""
        SELECT {day("date_trunc('month', first_day)", "month")}, count(*) AS new_customers
        FROM (SELECT customer_id, min(order_date) AS first_day FROM fct_orders WHERE is_delivered GROUP BY customer_id) f
        WHERE first_day BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY 1""",
    "q04_order_volume": f"""
        SELECT {_MONTH}, {_orders()}, count(DISTINCT customer_id) AS unique_customers,
               {num("count(*) / count(DISTINCT customer_id)", "orders_per_customer")} {_DONE} GROUP BY order_month""",
    "q05_order_value_distribution": f"""
        SELECT {_tier("total_order_value", v.ORDER_VALUE_5, "order_value_range")}, {_orders("order_count")}, {_REV}, {_AOV} {_DONE} GROUP BY 1""",
    "q06_delivery_performance": f"SELECT {_MONTH}, {_DAYS}, {_VS}, {_EARLY}, {_ONTIME}, {_LATE} {_DONE} GROUP BY order_month",
    "q06_delivery_performance_long": f"""
        WITH wide AS (SELECT {_MONTH}, {_EARLY}, {_ONTIME}, {_LATE} {_DONE} GROUP BY order_month)
        UNPIVOT wide ON early_pct, ontime_pct, late_pct INTO NAME performance VALUE percentage""",
    "q07_satisfaction_trend": f"""
        SELECT {_MONTH}, {avg("review_score")}, {share("review_score = 5", "five_star_pct")}, {share("review_score > 3", "positive_pct")},
               {share("review_score = 3", "neutral_pct")}, {share("review_score < 3", "negative_pct")}
        {_DONE} AND review_score IS NOT NULL GROUP BY order_month""",
    "q08_review_distribution": f"""
        SELECT review_score, count(*) AS review_count, {num("100.0 * count(*) / sum(count(*)) OVER ()", "percentage")}
        {_DONE} AND review_score IS NOT NULL GROUP BY review_score""",
}

_INSTALLMENT_RANGE = (
    "CASE " + " ".join(f"WHEN max_installments BETWEEN {a} AND {b} THEN {quote(t)}" for a, b, t in v.INSTALLMENT_RANGES)
    + f" ELSE {quote(v.INSTALLMENT_RANGE_OTHER)} END"
)
_PEOPLE = f"""
    SELECT customer_id, count(*) AS n, sum(total_order_value) AS ltv, avg(total_order_value) AS aov,
           date_diff('day', min(order_date), max(order_date)) AS tenure {_DONE} GROUP BY customer_id"""

REVENUE = {
    "q09_payment_mix": f"""
        SELECT primary_payment_method, {_orders("order_count")}, {num("100.0 * count(*) / sum(count(*)) OVER ()", "pct_of_orders")},
               {num("sum(total_payment_value)", "total_revenue")},
               {num("100.0 * CAST(sum(total_payment_value) AS DOUBLE) / sum(sum(total_payment_value)) OVER ()", "pct_of_revenue")},
               {avg("total_payment_value", "avg_order_value")}, {avg("max_installments", "avg_installments")}
        {_DONE} AND primary_payment_method IS NOT NULL GROUP BY primary_payment_method""",
    "q10_installments": f"""
        SELECT {_INSTALLMENT_RANGE} AS installment_range, {_orders("order_count")}, {num("sum(total_payment_value)", "total_revenue")},
               {avg("total_payment_value", "avg_order_value")}, {avg("max_installments", "avg_installments")},
               {num("sum(total_payment_value) * (1 - 1 / avg(max_installments))", "working_capital_impact")}
        {_DONE} AND max_installments IS NOT NULL GROUP BY 1""",
    "q11_order_value_tiers": f"""
        SELECT {_tier("total_order_value", v.ORDER_VALUE_7, "value_range")}, {_orders("order_count")}, {_REV}, {_AOV},
               {num("100.0 * count(*) / sum(count(*)) OVER ()", "pct_orders")},
               {num("100.0 * CAST(sum(total_order_value) AS DOUBLE) / sum(sum(total_order_value)) OVER ()", "pct_revenue")} {_DONE} GROUP BY 1""",
    "q12_freight_burden": f"""
        SELECT {_tier("total_order_value", v.ORDER_VALUE_4, "order_value_range")}, {_orders("order_count")}, {avg("total_freight", "avg_freight")},
               {_AOV}, {num("avg(100.0 * CAST(total_freight AS DOUBLE) / total_order_value)", "avg_freight_pct")}
        {_DONE} AND total_order_value > 0 GROUP BY 1""",
    "q13_seasonality": f"""
        SELECT month(order_date) AS month_num, strftime(order_date, '%b') AS month_name, {_orders("order_count")}, {_REV}, {_AOV} {_DONE} GROUP BY 1, 2""",
    "q14_lifetime_value": f"""
        SELECT {_tier("n", v.ORDER_COUNT_LTV, "customer_segment")}, count(*) AS customer_count, {avg("ltv")}, {num("sum(ltv)", "total_revenue")},
               {avg("aov", "avg_order_value")}, {avg("tenure", "avg_tenure_days")} FROM ({_PEOPLE}) p GROUP BY 1""",
    "q15_delivery_speed_revenue": f"""
        SELECT {_tier("days_to_delivery", v.DELIVERY_SPEED, "delivery_speed")}, {_orders("order_count")}, {_REV}, {_AOV}, {avg("review_score")},
               {avg("total_freight", "avg_freight")} {_DONE} AND days_to_delivery IS NOT NULL GROUP BY 1""",
}

_GAPS = f"""
    gaps AS (
        SELECT customer_id, date_diff('day', first_day, second_day) AS days
        FROM (SELECT customer_id, max(order_date) FILTER (place = 1) AS first_day, max(order_date) FILTER (place = 2) AS second_day
              FROM (SELECT customer_id, order_date, row_number() OVER (PARTITION BY customer_id ORDER BY order_date) AS place
                    FROM fct_orders WHERE is_delivered) o GROUP BY customer_id) f
        WHERE second_day IS NOT NULL AND first_day >= DATE '{START}' AND second_day <= DATE '{END}')"""
_BINS = " ".join(
    f"WHEN days > {a} AND days <= {b} THEN {quote(t)}" if b else f"WHEN days > {a} THEN {quote(t)}" for a, b, t in v.SECOND_PURCHASE_BINS
)
_COHORT = f"""
    cohort AS (
        SELECT cohort_month, date_diff('month', cohort_month, order_month) AS months_since_first, count(DISTINCT customer_id) AS active_customers
        FROM fct_orders JOIN (SELECT customer_id, min(order_month) AS cohort_month FROM fct_orders WHERE is_delivered GROUP BY customer_id) c USING (customer_id)
        WHERE is_delivered AND {_PERIOD} AND cohort_month >= DATE '{START}' GROUP BY ALL)"""
_GRID = f"""{_COHORT},
    grid AS (
        SELECT a.cohort_month, b.months_since_first, coalesce(c.active_customers, 0) AS active_customers,
               100.0 * coalesce(c.active_customers, 0) / z.active_customers AS pct
        FROM (SELECT DISTINCT cohort_month FROM cohort) a CROSS JOIN (SELECT DISTINCT months_since_first FROM cohort) b
        LEFT JOIN cohort c USING (cohort_month, months_since_first)
        LEFT JOIN cohort z ON z.cohort_month = a.cohort_month AND z.months_since_first = 0)"""

RETENTION = {
    "q16_retention_kpis": f"""
        SELECT count(*) AS total_customers, count(*) FILTER (n = 1) AS one_time_customers, count(*) FILTER (n > 1) AS repeat_customers,
               {share("n > 1", "repeat_rate")}, {avg("n", "avg_orders_per_customer")},
               {num("avg(tenure) FILTER (n > 1)", "avg_customer_lifetime_days")} FROM ({_PEOPLE}) p""",
    "q17_order_count_segments": f"""
        SELECT {_tier("n", v.ORDER_COUNT_RETENTION, "customer_segment")}, count(*) AS customer_count, {num("sum(ltv)", "total_revenue")},
               {avg("ltv")}, {avg("aov")}, {num("100.0 * count(*) / sum(count(*)) OVER ()", "customer_pct")},
               {num("100.0 * CAST(sum(ltv) AS DOUBLE) / sum(sum(ltv)) OVER ()", "revenue_pct")} FROM ({_PEOPLE}) p GROUP BY 1""",
    "q18_days_to_second_purchase": f"WITH {_GAPS} SELECT customer_id, days AS days_to_second_purchase FROM gaps",
    "q18_second_purchase_summary": f"""
        WITH {_GAPS} SELECT count(*) AS customers, {avg("days")}, {num("median(days)", "median_days")} FROM gaps""",
    "q18_second_purchase_bins": f"""
        WITH {_GAPS} SELECT CASE {_BINS} END AS days_bucket, count(*) AS customer_count FROM gaps WHERE days > 0 GROUP BY 1""",
    "q19_cohort_activity": f"WITH {_COHORT} SELECT * REPLACE ({day('cohort_month')}) FROM cohort",
    "q19_cohort_retention": f"""
        WITH {_GRID} SELECT {day("cohort_month")}, months_since_first, active_customers, {num("pct", "retention_pct")} FROM grid""",
    "q19_cohort_matrix": f"""
        WITH {_GRID} SELECT {day("cohort_month")},
               {", ".join(num(f"coalesce(max(pct) FILTER (months_since_first = {m}), if(bool_or(pct IS NOT NULL), 0, NULL))", f"month_{m}") for m in range(84))}
        FROM grid GROUP BY cohort_month""",
    "q19_retention_curve": f"""
        WITH {_GRID} SELECT months_since_first, {avg("pct", "avg_retention_pct")} FROM grid GROUP BY months_since_first""",
    "q20_monthly_churn": f"""
        WITH months AS (SELECT order_month, count(DISTINCT customer_id) AS now {_DONE} GROUP BY order_month),
        pairs AS (SELECT *, lag(now) OVER (ORDER BY order_month) AS before FROM months)
        SELECT {_MONTH}, now AS active_customers, before AS prev_active_customers, {num("100.0 * (before - now) / before", "churn_rate")},
               {num("100.0 * (now - before) / before", "net_active_change_pct")} FROM pairs WHERE before IS NOT NULL""",
    "q21_review_writers": f"""
        WITH people AS (
            SELECT customer_id, count(DISTINCT order_id) AS n, sum(total_order_value) AS ltv, avg(total_order_value) AS aov,
                   count(review_score) AS written, date_diff('day', min(order_date), max(order_date)) AS lifetime {_DONE} GROUP BY customer_id)
        SELECT if(written > 0, 'Review Writers', 'Non-Review Writers') AS customer_type, count(*) AS customer_count, {avg("n", "avg_orders")},
               {avg("ltv")}, {avg("aov")}, {share("n > 1", "repeat_rate")}, {avg("lifetime", "avg_lifetime_days")} FROM people GROUP BY 1""",
}

_CM = "FROM mart_customer_analytics"
_N = "count(DISTINCT customer_id) AS customer_count"
_LTV = num("sum(lifetime_value)", "total_ltv")
_CUSTOMER_AVERAGES = (
    f"{avg('lifetime_value', 'avg_ltv')}, {avg('total_orders', 'avg_orders')}, {avg('recency_days', 'avg_recency')}, "
    f"{avg('avg_review_score', 'avg_satisfaction')}"
)
_AT_RISK = "rfm_segment = 'At Risk' AND lifecycle_stage = 'Dormant'"
_KPI = f"SELECT count(DISTINCT customer_id) AS total_customers, {_LTV}, {_CUSTOMER_AVERAGES} {_CM}"

RFM = {
    "q22_segment_list": f"SELECT DISTINCT rfm_segment {_CM} WHERE rfm_segment IS NOT NULL",
    "q23_customer_kpis": _KPI,
    "q23_customer_kpis_filtered": f"{_KPI} WHERE {_AT_RISK}",
    "q24_segment_summary": f"""
        SELECT rfm_segment, {_N}, {_LTV}, {_CUSTOMER_AVERAGES}, {avg("rfm_total_score", "avg_rfm_score")} {_CM}
        WHERE rfm_segment IS NOT NULL GROUP BY rfm_segment""",
    "q25_score_counts": f"SELECT recency_score, frequency_score, monetary_score, {_N} {_CM} GROUP BY ALL",
    "q26_scores_by_segment": f"""
        SELECT rfm_segment, {avg("recency_score", "avg_r")}, {avg("frequency_score", "avg_f")}, {avg("monetary_score", "avg_m")} {_CM}
        WHERE rfm_segment IS NOT NULL GROUP BY rfm_segment""",
    "q27_lifecycle_summary": f"SELECT lifecycle_stage, {_N}, {_LTV}, {_CUSTOMER_AVERAGES} {_CM} GROUP BY lifecycle_stage",
    "q28_value_tier_summary": f"""
        SELECT value_tier, {_N}, {_LTV}, {avg("lifetime_value", "avg_ltv")}, {avg("total_orders", "avg_orders")},
               {num("min(lifetime_value)", "min_ltv")}, {num("max(lifetime_value)", "max_ltv")} {_CM} GROUP BY value_tier""",
    "q29_segment_characteristics": f"""
        SELECT rfm_segment, count(DISTINCT customer_id) AS customers, {avg("recency_days")}, {avg("frequency")},
               {avg("monetary_value", "avg_monetary")}, {avg("lifetime_value", "avg_ltv")}, {avg("total_orders", "avg_orders")},
               {avg("avg_order_value", "avg_order_value")}, {avg("avg_review_score", "avg_satisfaction")},
               {avg("on_time_delivery_rate", "avg_on_time_rate")},
               {num("100.0 * CAST(sum(lifetime_value) AS DOUBLE) / sum(sum(lifetime_value)) OVER ()", "ltv_contribution_pct")}
        {_CM} WHERE rfm_segment IS NOT NULL GROUP BY rfm_segment""",
    "q30_reactivation_targets": f"""
        SELECT rfm_segment, lifecycle_stage, {_N}, {num("sum(lifetime_value)", "historical_ltv")}, {avg("total_orders", "avg_past_orders")},
               {avg("recency_days", "avg_days_since_purchase")}, {avg("avg_review_score", "avg_past_satisfaction")} {_CM}
        WHERE rfm_segment IN ('At Risk', 'Lost') OR lifecycle_stage IN ('Cooling Down', 'At Risk', 'Dormant') GROUP BY ALL""",
    "q31_segment_by_region": f"""
        SELECT region, rfm_segment, {_N}, {_LTV} {_CM} WHERE region IS NOT NULL AND rfm_segment IS NOT NULL GROUP BY region, rfm_segment""",
    "q32_behavior_patterns": f"""
        SELECT rfm_segment, {avg("avg_days_between_orders", "avg_repurchase_cycle")}, {avg("avg_items_per_order", "avg_basket_size")},
               {num("100.0 * sum(installment_orders) / nullif(sum(total_orders), 0)", "installment_rate")},
               {num("100.0 * sum(orders_with_comments) / nullif(sum(total_orders), 0)", "comment_rate")},
               {avg("unique_categories_purchased", "avg_categories")} {_CM} WHERE rfm_segment IS NOT NULL GROUP BY rfm_segment""",
}

_RATED = f"{_DONE} AND review_score IS NOT NULL"
_STATE_SAT = f"""
    SELECT customer_state, {_orders()}, {_RATING}, {_PRO}, {_CON}, {_DAYS}, {_AOV}, {_NPS} {_RATED} AND customer_state IS NOT NULL
    GROUP BY customer_state HAVING count(*) >= 100"""
_FACTORS = f"""
    SELECT {_tier("total_order_value", v.ORDER_VALUE_4, "order_value_segment")}, primary_payment_method, delivery_performance,
           {_tier("total_freight", v.FREIGHT_SEGMENT, "freight_segment")}, count(*) AS order_count, avg(review_score) AS rating,
           {pct("count(*) FILTER (review_score > 3)")} AS positive {_RATED} GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10"""


def _factor(column: str) -> str:
    return f"""
        SELECT {column}, CAST(sum(order_count) AS BIGINT) AS order_count, {avg("rating")}, {avg("positive", "positive_pct")}
        FROM ({_FACTORS}) f WHERE {column} IS NOT NULL GROUP BY {column}"""


def _extremes(states: str, measure: str, best: str, worst: str) -> str:
    return f"""
        WITH states AS ({states}),
        ranked AS (SELECT *, row_number() OVER (ORDER BY {measure} {best}, customer_state) AS b,
                          row_number() OVER (ORDER BY {measure} {worst}, customer_state) AS w FROM states)
        SELECT * EXCLUDE (b, w), 'best' AS side FROM ranked WHERE b <= 10
        UNION ALL SELECT * EXCLUDE (b, w), 'worst' FROM ranked WHERE w <= 10"""


SATISFACTION = {
    "q33_satisfaction_kpis": f"""
        SELECT {_orders("total_orders_with_reviews")}, {avg("review_score")}, {_PRO}, {share("review_score = 3", "passives_pct")}, {_CON}, {_NPS},
               count(*) FILTER (review_score = 5) AS five_star, count(*) FILTER (review_score = 4) AS four_star,
               count(*) FILTER (review_score = 3) AS three_star, count(*) FILTER (review_score = 2) AS two_star,
               count(*) FILTER (review_score = 1) AS one_star {_RATED}""",
    "q33_rating_distribution": f"""
        SELECT rating, count(review_score) AS count, {num("100.0 * count(review_score) / sum(count(review_score)) OVER ()", "percentage")}
        FROM (VALUES (5), (4), (3), (2), (1)) s(rating) LEFT JOIN (SELECT review_score {_RATED}) r ON rating = review_score GROUP BY rating""",
    "q34_nps_trend": f"SELECT {_MONTH}, {_orders('total_reviews')}, {_RATING}, {_PRO}, {_CON}, {_NPS} {_RATED} GROUP BY order_month",
    "q35_rating_by_performance": f"""
        SELECT delivery_performance, {_orders("order_count")}, {_RATING}, {share("review_score > 3", "positive_pct")},
               {share("review_score < 3", "negative_pct")}, {_DAYS} {_RATED} AND delivery_performance IS NOT NULL GROUP BY delivery_performance""",
    "q36_rating_by_delivery_time": f"""
        SELECT {_tier("days_to_delivery", v.DELIVERY_DAYS, "delivery_bucket")}, {avg("days_to_delivery", "avg_days")}, {_orders("order_count")},
               {_RATING}, {share("review_score > 3", "positive_pct")} {_RATED} AND days_to_delivery IS NOT NULL GROUP BY 1""",
    "q37_state_satisfaction": _STATE_SAT,
    "q37_state_satisfaction_extremes": _extremes(_STATE_SAT, "avg_rating", "DESC", "ASC"),
    "q38_satisfaction_factors": f"""
        SELECT * EXCLUDE (rating, positive), {num("rating", "avg_rating")}, {num("positive", "positive_pct")} FROM ({_FACTORS}) f""",
    "q38_factors_by_order_value": _factor("order_value_segment"),
    "q38_factors_by_payment": _factor("primary_payment_method"),
    "q38_factors_by_freight": _factor("freight_segment"),
}

_HERE = f"{_DONE} AND days_to_delivery IS NOT NULL"
_FREIGHT = avg("total_freight", "avg_freight_cost")
_STATE_DELIVERY = f"""
    SELECT customer_state, {_orders()}, {_DAYS}, {_VS}, {_LATE}, {_SAT}, {_FREIGHT} {_HERE} AND customer_state IS NOT NULL
    GROUP BY customer_state HAVING count(*) >= 100"""
_CYCLE = (
    f"{num('avg(hours_to_approval) / 24', 'avg_days_to_approval')}, {avg('days_to_delivery', 'avg_days_to_delivery')}"
)

DELIVERY = {
    "q39_delivery_kpis": f"""
        SELECT {_orders()}, {_DAYS}, {num("median(days_to_delivery)", "median_delivery_days")}, {_VS}, {_EARLY}, {_ONTIME}, {_LATE},
               count(*) FILTER (delivery_performance = 'late') AS late_orders, {_SAT}, {_FREIGHT} {_HERE}""",
    "q40_delivery_trend": f"SELECT {_MONTH}, {_orders()}, {_DAYS}, {_VS}, {_EARLY}, {_ONTIME}, {_LATE}, {_SAT} {_HERE} GROUP BY order_month",
    "q40_delivery_trend_long": f"""
        WITH wide AS (SELECT {_MONTH}, {_EARLY}, {_ONTIME}, {_LATE} {_HERE} GROUP BY order_month)
        UNPIVOT wide ON early_pct, ontime_pct, late_pct INTO NAME performance VALUE percentage""",
    "q41_state_delivery": _STATE_DELIVERY,
    "q41_state_delivery_extremes": _extremes(_STATE_DELIVERY, "avg_delivery_days", "ASC", "DESC"),
    "q41_latest_states": f"SELECT * FROM ({_STATE_DELIVERY}) s ORDER BY late_pct DESC, customer_state LIMIT 15",
    "q42_satisfaction_by_delivery_time": f"""
        SELECT {_tier("days_to_delivery", v.DELIVERY_DAYS, "delivery_time_bucket")}, {_orders("order_count")}, {_SAT},
               {share("review_score > 3", "positive_review_pct")}, {_DAYS} {_HERE} AND review_score IS NOT NULL GROUP BY 1""",
    "q43_satisfaction_by_performance": f"""
        SELECT delivery_performance, {_orders("order_count")}, {_SAT}, {_DAYS}, {_VS} {_RATED} AND delivery_performance IS NOT NULL GROUP BY 1""",
    "q44_freight_and_delivery": f"""
        SELECT {_tier("total_freight", v.FREIGHT_RANGE, "freight_range")}, {_orders("order_count")}, {avg("total_freight", "avg_freight")}, {_DAYS},
               {_LATE}, {_SAT} {_HERE} AND total_freight IS NOT NULL GROUP BY 1""",
    "q45_fulfillment_cycle": f"""
        SELECT {_MONTH}, {_CYCLE}, {num("avg(hours_to_approval / 24 + days_to_delivery)", "total_cycle_time")}, {_orders("order_count")}
        {_HERE} AND hours_to_approval IS NOT NULL GROUP BY order_month""",
    "q45_fulfillment_cycle_long": f"""
        WITH wide AS (SELECT {_MONTH}, {_CYCLE} {_HERE} AND hours_to_approval IS NOT NULL GROUP BY order_month)
        UNPIVOT wide ON avg_days_to_approval, avg_days_to_delivery INTO NAME stage VALUE days""",
}

_PLACES = f"{_DONE} AND customer_state IS NOT NULL"
_STATES = f"""
    SELECT customer_state, count(DISTINCT customer_id) AS unique_customers, {_orders()}, {_REV}, {_AOV}, {avg("total_freight", "avg_freight")},
           {num("avg(100.0 * CAST(total_freight AS DOUBLE) / nullif(total_order_value, 0))", "freight_pct")}, {_SAT}, {_DAYS},
           {num("100.0 * CAST(sum(total_order_value) AS DOUBLE) / sum(sum(total_order_value)) OVER ()", "revenue_pct")},
           {num("100.0 * count(*) / sum(count(*)) OVER ()", "orders_pct")},
           {num("CAST(sum(total_order_value) AS DOUBLE) / count(DISTINCT customer_id)", "revenue_per_customer")},
           {num("count(*) / count(DISTINCT customer_id)", "orders_per_customer")} {_PLACES} GROUP BY customer_state"""
_GROWTH = f"""
    SELECT customer_state, {num("a", "first_year_revenue")}, {num("b", "second_year_revenue")},
           {num("CASE WHEN a > 0 THEN 100 * (CAST(b AS DOUBLE) / a - 1) END", "revenue_growth_pct")},
           {num("CASE WHEN x > 0 THEN 100 * (CAST(y AS DOUBLE) / x - 1) END", "orders_growth_pct")}
    FROM (SELECT customer_state, sum(total_order_value) FILTER (early) AS a, sum(total_order_value) FILTER (NOT early) AS b,
                 count(*) FILTER (early) AS x, count(*) FILTER (NOT early) AS y
          FROM (SELECT *, order_date < DATE '{START}' + INTERVAL 12 MONTH AS early {_PLACES}) o GROUP BY customer_state) s
    WHERE a IS NOT NULL AND b IS NOT NULL"""

GEOGRAPHY = {
    "q46_state_revenue": _STATES,
    "q46_top_states_by_revenue": f"SELECT * FROM ({_STATES}) s ORDER BY total_revenue DESC, customer_state LIMIT 15",
    "q46_top_states_by_unit_economics": f"SELECT * FROM ({_STATES}) s ORDER BY revenue_per_customer DESC, customer_state LIMIT 15",
    "q47_top_cities": f"""
        SELECT customer_city, customer_state, count(DISTINCT customer_id) AS unique_customers, {_orders()}, {_REV}, {_AOV}, {_SAT},
               customer_city || ' (' || customer_state || ')' AS city_state
        {_DONE} AND customer_city IS NOT NULL GROUP BY customer_city, customer_state HAVING count(*) >= 50
        ORDER BY sum(total_order_value) DESC, customer_city, customer_state LIMIT 20""",
    "q48_state_growth": _GROWTH,
    "q48_fastest_growing_states": f"SELECT * FROM ({_GROWTH}) g ORDER BY revenue_growth_pct DESC NULLS LAST, customer_state LIMIT 15",
}

_VOLUME = f"{_orders()}, {_REV}, {_AOV}"
_JOINED = f"FROM dim_customers WHERE first_order_date BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"

TIMING = {
    "q49_by_day_of_week": f"SELECT dayofweek(order_date) AS day_of_week_num, dayname(order_date) AS day_of_week, {_VOLUME} {_DONE} GROUP BY 1, 2",
    "q50_by_month_of_year": f"""
        SELECT month(order_date) AS month_num, monthname(order_date) AS month_name, {_VOLUME}, count(DISTINCT customer_id) AS unique_customers {_DONE} GROUP BY 1, 2""",
    "q51_by_quarter": f"""
        SELECT quarter(order_date) AS quarter, year(order_date) AS year, {_VOLUME}, year(order_date) || ' Q' || quarter(order_date) AS period {_DONE} GROUP BY ALL""",
    "q52_by_hour": f"SELECT hour(order_purchase_timestamp) AS hour, {_VOLUME} {_DONE} GROUP BY 1",
    "q52_peaks": f"""
        (SELECT 'day_of_week' AS peak, dayname(order_date) AS value {_DONE} GROUP BY dayofweek(order_date), 2 ORDER BY count(*) DESC, dayofweek(order_date) LIMIT 1)
        UNION ALL (SELECT 'month', monthname(order_date) {_DONE} GROUP BY month(order_date), 2 ORDER BY sum(total_order_value) DESC, month(order_date) LIMIT 1)
        UNION ALL (SELECT 'hour', CAST(hour(order_purchase_timestamp) AS VARCHAR) {_DONE} GROUP BY hour(order_purchase_timestamp) ORDER BY count(*) DESC, hour(order_purchase_timestamp) LIMIT 1)""",
    "q53_reactivation_segments": f"""
        SELECT {_tier("days_since_last_order", v.REACTIVATION, "reactivation_segment")}, count(*) AS customer_count,
               {avg("lifetime_orders", "avg_orders")}, {avg("avg_review_score", "avg_satisfaction")}
        {_JOINED} AND days_since_last_order IS NOT NULL GROUP BY 1""",
    "q54_dormant_value": f"""
        WITH spent AS (SELECT customer_id, sum(total_order_value) AS ltv FROM fct_orders WHERE is_delivered GROUP BY customer_id)
        SELECT {_tier("days_since_last_order", v.DORMANCY, "segment")}, {_tier("ltv", v.DORMANT_VALUE, "value_segment")},
               count(*) AS customer_count, {avg("ltv")}
        FROM (SELECT * {_JOINED}) c JOIN spent USING (customer_id) WHERE days_since_last_order >= 90 AND lifetime_orders > 1 GROUP BY 1, 2""",
}

_LOST = num("coalesce(sum(total_order_value) FILTER (is_canceled), 0)", "canceled_revenue")
_STATE_CANCEL = f"SELECT customer_state, {_CANCEL}, {_AOV} {_ALL} AND customer_state IS NOT NULL GROUP BY customer_state HAVING count(*) >= 100"
_PARTS = f"""
    SELECT max_installments, count(*) AS order_count, 100.0 * count(*) / sum(count(*)) OVER () AS order_share, sum(total_order_value) AS revenue,
           avg(total_order_value) AS aov, {pct("count(*) FILTER (is_canceled)")} AS lost, avg(review_score) FILTER (is_delivered) AS liked
    {_ALL} AND max_installments IS NOT NULL GROUP BY max_installments"""
_PARTS_SHOWN = f"""
    SELECT max_installments, order_count, {num("order_share", "order_pct")}, {num("revenue", "total_revenue")}, {num("aov", "avg_order_value")},
           {num("lost", "cancellation_rate")}, {num("liked", "avg_satisfaction")} FROM ({_PARTS}) p"""
_FAILED = f"count(*) AS total_orders, count(*) FILTER (is_canceled) AS failed_orders, {share('is_canceled', 'failure_rate')}"

RISK = {
    "q55_cancellation_kpis": f"""
        SELECT {_CANCEL}, count(*) FILTER (is_delivered) AS delivered_orders, {_LOST},
               {num("avg(total_order_value) FILTER (is_canceled)", "avg_canceled_order_value")},
               {num("avg(total_order_value) FILTER (is_delivered)", "avg_delivered_order_value")} {_ALL}""",
    "q56_cancellation_trend": f"SELECT {_MONTH}, {_CANCEL}, {_LOST} {_ALL} GROUP BY order_month",
    "q57_cancellation_by_value": f"SELECT {_tier('total_order_value', v.ORDER_VALUE_5, 'order_value_range')}, {_CANCEL}, {_AOV} {_ALL} GROUP BY 1",
    "q58_cancellation_by_state": _STATE_CANCEL,
    "q58_riskiest_states": f"SELECT * FROM ({_STATE_CANCEL}) s ORDER BY cancellation_rate DESC, customer_state LIMIT 15",
    "q59_cancellation_by_payment": f"""
        SELECT primary_payment_method, {_CANCEL} {_ALL} AND primary_payment_method IS NOT NULL GROUP BY primary_payment_method""",
    "q60_installment_distribution": _PARTS_SHOWN,
    "q60_installment_distribution_to_12": f"{_PARTS_SHOWN} WHERE max_installments <= 12",
    "q60_installment_groups": f"""
        SELECT CASE WHEN max_installments = 1 THEN '1x' WHEN max_installments <= 3 THEN '2-3x' WHEN max_installments <= 6 THEN '4-6x'
                    WHEN max_installments <= 10 THEN '7-10x' ELSE '10+x' END AS installment_group,
               {whole("sum(order_count)", "order_count")}, {num("sum(revenue)", "total_revenue")}, {avg("aov", "avg_order_value")},
               {avg("lost", "cancellation_rate")}, {avg("liked", "avg_satisfaction")} FROM ({_PARTS}) p GROUP BY 1""",
    "q61_payment_failure": f"""
        SELECT primary_payment_method, {_FAILED}, {avg("max_installments", "avg_installments")}, {_AOV}
        {_ALL} AND primary_payment_method IS NOT NULL GROUP BY primary_payment_method""",
    "q62_payment_failure_by_state": f"""
        SELECT customer_state, primary_payment_method, {_FAILED} {_ALL} AND customer_state IS NOT NULL AND primary_payment_method IS NOT NULL
        GROUP BY customer_state, primary_payment_method HAVING count(*) >= 50
        ORDER BY count(*) FILTER (is_canceled) / count(*) DESC, customer_state, primary_payment_method LIMIT 30""",
}

_PM = "FROM mart_product_performance WHERE total_units_sold >= 1"
_CAT = "product_category_name_english"
_ITEMS = "count(DISTINCT product_id) AS product_count"
_UNITS = whole("sum(total_units_sold)", "total_units")
_ONTIME_RATE = avg("on_time_delivery_rate", "avg_on_time_rate")
_PRODUCT_KPI = f"""
    SELECT count(DISTINCT product_id) AS total_products, {_UNITS}, {num("sum(total_revenue)", "total_revenue")},
           {avg("avg_review_score", "avg_review_score")}, {_ONTIME_RATE}, count(DISTINCT product_id) AS active_products {_PM}"""

PRODUCT = {
    "q63_category_list": f"SELECT DISTINCT {_CAT} FROM mart_product_performance WHERE {_CAT} IS NOT NULL",
    "q64_product_kpis": _PRODUCT_KPI,
    "q64_product_kpis_filtered": f"{_PRODUCT_KPI} AND {_CAT} = 'toys' AND total_units_sold >= 20",
    "q65_top_products": f"""
        SELECT {_CAT} AS category, total_units_sold, {num("total_revenue")}, {num("avg_price")}, {num("avg_review_score")}, total_reviews,
               {num("on_time_delivery_rate")}, sales_tier, review_tier
        {_PM} ORDER BY mart_product_performance.total_units_sold DESC, product_id LIMIT 20""",
    "q66_top_categories": f"""
        SELECT {_CAT} AS category, {_ITEMS}, {_UNITS}, {num("sum(total_revenue)", "total_revenue")}, {avg("avg_price", "avg_price")},
               {avg("avg_review_score", "avg_review")}, {_ONTIME_RATE},
               {num("CAST(sum(total_revenue) AS DOUBLE) / sum(total_units_sold)", "revenue_per_unit")}
        {_PM} AND {_CAT} IS NOT NULL GROUP BY {_CAT} ORDER BY sum(mart_product_performance.total_revenue) DESC, {_CAT} LIMIT 15""",
    "q67_price_and_review": f"""
        SELECT {_CAT} AS category, {num("avg_price")}, {num("avg_review_score")}, total_units_sold, total_reviews, {num("on_time_delivery_rate")}
        {_PM} AND avg_review_score IS NOT NULL""",
    "q68_sales_tiers": f"""
        SELECT sales_tier, {_ITEMS}, {num("sum(total_revenue)", "tier_revenue")}, {avg("avg_review_score", "avg_review")} {_PM} GROUP BY sales_tier""",
    "q69_review_tiers": f"""
        SELECT review_tier, {_ITEMS}, {avg("total_units_sold", "avg_units_sold")}, {avg("avg_review_score", "avg_score")}
        {_PM} AND review_tier <> 'No Reviews' GROUP BY review_tier""",
    "q70_delivery_by_category": f"""
        SELECT {_CAT} AS category, {_ONTIME_RATE}, {avg("avg_delivery_days", "avg_delivery_days")}, {_UNITS}, {avg("avg_review_score", "avg_review")}
        {_PM} AND {_CAT} IS NOT NULL AND on_time_delivery_rate IS NOT NULL GROUP BY {_CAT} ORDER BY avg(on_time_delivery_rate) DESC, {_CAT} LIMIT 15""",
    "q71_geographic_reach": f"""
        SELECT {_CAT} AS category, {avg("unique_customer_states", "avg_states_reached")},
               {avg("unique_customer_locations", "avg_locations_reached")}, {_UNITS}, {avg("same_state_sales_rate", "avg_same_state_rate")}
        {_PM} AND {_CAT} IS NOT NULL GROUP BY {_CAT} ORDER BY avg(unique_customer_states) DESC, {_CAT} LIMIT 15""",
}

_SM = "FROM mart_seller_scorecard WHERE total_orders >= 1"
_VENDORS = "count(DISTINCT seller_id) AS seller_count"
_SREV = num("sum(total_revenue)", "total_revenue")
_SELLER_KPI = f"""
    SELECT count(DISTINCT seller_id) AS total_sellers, {_SREV}, {whole("sum(total_orders)", "total_orders")},
           {avg("avg_review_score", "avg_review_score")}, {_ONTIME_RATE}, {avg("overall_performance_score", "avg_performance_score")} {_SM}"""

SELLER = {
    **{
        f"q{n}_{column}_list": f"SELECT DISTINCT {column} FROM mart_seller_scorecard WHERE {column} IS NOT NULL"
        for n, column in ((72, "seller_health"), (73, "activity_status"), (74, "region"))
    },
    "q75_marketplace_kpis": _SELLER_KPI,
    "q75_marketplace_kpis_filtered": f"{_SELLER_KPI} AND region = 'Northeast' AND seller_health = 'Needs Improvement' AND total_orders >= 10",
    "q76_top_sellers": f"""
        SELECT seller_id, seller_state, region, total_orders, {num("total_revenue")}, {num("avg_review_score")}, {num("on_time_delivery_rate")},
               {num("overall_performance_score")}, seller_health, activity_status, seller_performance_tier
        {_SM} AND overall_performance_score IS NOT NULL ORDER BY mart_seller_scorecard.overall_performance_score DESC, seller_id LIMIT 20""",
    "q77_health_distribution": f"""
        SELECT seller_health, {_VENDORS}, {_SREV}, {avg("total_orders", "avg_orders")}, {avg("avg_review_score", "avg_review")}, {_ONTIME_RATE}
        {_SM} GROUP BY seller_health""",
    "q78_activity_distribution": f"""
        SELECT activity_status, {_VENDORS}, {_SREV}, {avg("orders_last_30_days", "avg_orders_30d")}, {avg("orders_last_90_days", "avg_orders_90d")}
        {_SM} GROUP BY activity_status""",
    "q79_revenue_by_tier": f"""
        SELECT seller_performance_tier, {_VENDORS}, {_SREV}, {avg("revenue_per_order")}, {avg("revenue_per_day_active", "avg_revenue_per_day")},
               {avg("total_orders", "avg_orders")} {_SM} AND seller_performance_tier IS NOT NULL GROUP BY seller_performance_tier""",
    "q80_top_by_percentile": f"""
        SELECT seller_id, seller_state, {num("total_revenue")}, {num("revenue_per_order")}, {num("revenue_per_month")}, {num("revenue_percentile")},
               seller_performance_tier {_SM} AND revenue_percentile IS NOT NULL ORDER BY mart_seller_scorecard.revenue_percentile DESC, seller_id LIMIT 100""",
    "q80_percentile_histogram": f"""
        SELECT bin, {num("bin * 5", "from_percentile")}, count(*) AS seller_count
        FROM (SELECT CAST(least(floor(revenue_percentile / 5), 19) AS BIGINT) AS bin {_SM}) b GROUP BY bin""",
    "q81_specialization": f"""
        SELECT product_diversity_type, {_VENDORS}, {avg("unique_products_sold", "avg_products")}, {avg("unique_categories", "avg_categories")},
               {avg("total_revenue", "avg_revenue")}, {avg("avg_review_score", "avg_review")} {_SM} GROUP BY product_diversity_type""",
    "q82_region_summary": f"""
        SELECT region, {_VENDORS}, {_SREV}, {avg("unique_customer_states", "avg_states_reached")}, {avg("same_state_order_rate", "avg_same_state_rate")}
        {_SM} AND region IS NOT NULL GROUP BY region""",
    "q83_geographic_focus": f"""
        SELECT geographic_focus, {_VENDORS}, {avg("total_revenue", "avg_revenue")}, {avg("same_state_order_rate", "avg_same_state_rate")},
               {avg("unique_customer_states", "avg_states_reached")} {_SM} GROUP BY geographic_focus""",
    "q84_delivery_and_review": f"""
        SELECT seller_id, {num("on_time_delivery_rate")}, {num("avg_review_score")}, {num("total_revenue")}, total_orders, seller_health,
               {num("positive_review_rate")} {_SM} AND on_time_delivery_rate IS NOT NULL AND avg_review_score IS NOT NULL""",
}

EVERYDAY = {
    "everyday_revenue_by_month": f"""
        SELECT {_MONTH}, {num("round(sum(total_item_value), 2)", "revenue")}
        FROM stg_orders JOIN stg_order_items USING (order_id) WHERE order_status = 'delivered' GROUP BY order_month""",
    "everyday_top_categories": f"""
        SELECT {_CAT} AS category, count(DISTINCT order_id) AS orders, {num("round(sum(price), 2)", "revenue")}
        FROM int_order_items_enriched WHERE {_CAT} IS NOT NULL GROUP BY {_CAT} ORDER BY sum(price) DESC, {_CAT} LIMIT 10""",
    "everyday_score_distribution": f"""
        SELECT review_score, count(*) AS count, {num("100.0 * count(*) / sum(count(*)) OVER ()", "percentage")} FROM stg_reviews GROUP BY review_score""",
    "everyday_daily_revenue": f"""
        SELECT {day("date_day")}, {num("sum(total_item_value)", "revenue")}
        FROM fct_order_items JOIN dim_date ON order_date_key = date_key GROUP BY date_day""",
}

_ACTIVE = "SELECT DISTINCT customer_id, order_month FROM fct_orders WHERE is_delivered"

ACTIVITY = {
    "activity_cohorts": RETENTION["q19_cohort_activity"],
    "activity_churn": RETENTION["q20_monthly_churn"],
    "activity_active_months": f"""
        SELECT {whole("n", "active_months")}, count(*) AS customers FROM (SELECT customer_id, count(*) AS n FROM ({_ACTIVE}) a GROUP BY 1) c GROUP BY n""",
    "activity_kept_between": f"""
        SELECT {day("a.order_month", "month")}, count(*) AS customers, count(b.customer_id) AS came_back, {num("100.0 * count(b.customer_id) / count(*)", "came_back_pct")}
        FROM ({_ACTIVE}) a LEFT JOIN ({_ACTIVE}) b ON a.customer_id = b.customer_id AND b.order_month = a.order_month + INTERVAL 1 MONTH GROUP BY a.order_month""",
    "reconcile_older_orders": f"""
        SELECT {day("order_month")}, order_id, if(late, 0, count(*)) AS left_rows, count(*) AS right_rows, if(late, 'only_right', 'changed') AS change
        FROM (SELECT *, order_month = DATE '1997-05-01' AS late FROM fct_orders) f
        WHERE late OR order_month = DATE '1996-03-01' AND order_id IN (SELECT order_id FROM stg_payments) GROUP BY order_month, order_id, late""",
    "reconcile_dashboards": f"""
        SELECT {day("date_trunc('month', a.date_day)", "month")}, {day("a.date_day", "date_day")}, 1 AS left_rows, 1 AS right_rows, 'changed' AS change
        FROM mart_executive_dashboard a JOIN mart_executive_dashboard_fanout_safe b ON a.date_day = b.date_day
        WHERE a.total_orders IS DISTINCT FROM b.total_orders OR CAST(a.total_revenue AS DECIMAL(18, 2)) IS DISTINCT FROM CAST(b.total_revenue AS DECIMAL(18, 2))""",
}

SKETCHES = {
    "sketch_monthly_orders": f"""
        SELECT {day("date_trunc('month', order_date)", "order_month")}, count(*) AS order_rows, count(DISTINCT customer_id) AS customers,
               TRUE AS customers_close, TRUE AS median_close
        FROM fct_orders WHERE order_date IS NOT NULL GROUP BY date_trunc('month', order_date)""",
}

STATEMENTS = {
    name: statement(sql)
    for group in (
        ACTIVITY, SKETCHES,
        EXECUTIVE, REVENUE, RETENTION, RFM, SATISFACTION, DELIVERY, GEOGRAPHY, TIMING, RISK, PRODUCT, SELLER, EVERYDAY,
    )
    for name, sql in group.items()
}

# the same over a period inside the data
BOUNDED = {START: "1996-03-15", END: "1998-02-10"}


def _bounded(sql: str) -> str:
    for whole, inside in BOUNDED.items():
        sql = sql.replace(f"'{whole}'", f"'{inside}'")
    return sql


STATEMENTS |= {
    f"{name}_bounded": statement(_bounded({**EXECUTIVE, **RETENTION, **GEOGRAPHY, **RISK}[name]))
    for name in (
        "q01_executive_kpis", "q02_revenue_trend", "q03_customer_acquisition", "q18_days_to_second_purchase",
        "q19_cohort_activity", "q19_cohort_retention", "q20_monthly_churn", "q46_state_revenue", "q48_state_growth",
        "q55_cancellation_kpis",
    )
}
