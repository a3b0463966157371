"""Analyses on hand-made orders: bins, gaps in the calendar, empty groups."""

import datetime as dt
from decimal import Decimal

import pytest

from bazarlytics.analyses import delivery, everyday, executive, geography, retention, revenue, risk, timing


@pytest.fixture
def orders(frame):
    """Rows of ``fct_orders`` from (customer, day) and optional columns."""
    schema = """order_id string, customer_id string, order_date date, order_month date,
        order_purchase_timestamp timestamp_ntz, is_delivered boolean, is_canceled boolean,
        total_order_value decimal(20,2), total_freight decimal(20,2), total_payment_value decimal(20,2),
        days_to_delivery double, days_vs_estimated double, hours_to_approval double, delivery_performance string,
        review_score int, is_positive_review boolean, max_installments int, primary_payment_method string,
        customer_state string, customer_city string"""

    def make(*rows):
        out = []
        for i, (customer, day, *more) in enumerate(rows):
            x = {"value": "10.00", "delivered": True, "score": 5, "days": 4.0, "parts": 1, **(more[0] if more else {})}
            d = dt.date.fromisoformat(day)
            score = x["score"]
            out.append((
                f"o{i}", customer, d, d.replace(day=1), dt.datetime(d.year, d.month, d.day, i % 24), x["delivered"], not x["delivered"],
                Decimal(x["value"]), Decimal("2.00"), Decimal(x["value"]), x["days"], -1.0, 1.0, "early", score,
                score is not None and score >= 4, x["parts"], "boleto", x.get("state", "SP"), "sp",
            ))
        return frame(out, schema)

    return make


def test_growth_goes_by_rows_not_by_calendar(orders):
    df = orders(("a", "2017-01-05"), ("a", "2017-03-05", {"value": "30.00"}))
    rows = executive.revenue_trend(df).collect()
    assert [r.mom_growth for r in rows] == [None, pytest.approx(200.0)]


def test_new_customers_need_their_first_order_in_the_period(orders):
    df = orders(
        ("old", "2016-12-31"), ("old", "2017-02-01"), ("new", "2017-02-02"),
        ("late", "2017-01-10", {"delivered": False}), ("late", "2017-03-01"),
    )
    row = executive.executive_kpis(df, "2017-01-01", "2017-12-31").first()
    assert (row.total_orders, row.total_customers, row.new_customers) == (3, 3, 1)


def test_second_purchase_bins_are_right_closed(orders):
    start = dt.date(2017, 1, 1)
    pairs = []
    for i, gap in enumerate([0, 30, 31, 365, 366]):
        pairs += [(f"c{i}", str(start)), (f"c{i}", str(start + dt.timedelta(days=gap)))]
    pairs += [("once", str(start)), ("c0", "2018-01-01")]
    df = orders(*pairs)
    gaps = sorted(r.days_to_second_purchase for r in retention.days_to_second_purchase(df).collect())
    assert gaps == [0, 30, 31, 365, 366]
    bins = {r.days_bucket: r.customer_count for r in retention.second_purchase_bins(df).collect()}
    assert bins == {"0-30 days": 1, "31-60 days": 1, "181-365 days": 1, "365+ days": 1}
    row = retention.second_purchase_summary(df).first()
    assert (row.customers, row.avg_days, row.median_days) == (5, pytest.approx(158.4), 31.0)


def test_cohorts_fill_gaps_with_zero(orders):
    df = orders(("a", "2017-01-05"), ("b", "2017-01-06"), ("a", "2017-03-05"), ("c", "2017-02-01"), ("c", "2017-03-02"))
    rows = {(str(r.cohort_month), r.months_since_first): r.retention_pct for r in retention.cohort_retention(df).collect()}
    assert rows[("2017-01-01", 1)] == 0.0 and rows[("2017-01-01", 2)] == 50.0 and rows[("2017-02-01", 1)] == 100.0
    curve = {r.months_since_first: r.avg_retention_pct for r in retention.retention_curve(df).collect()}
    assert curve == {0: 100.0, 1: 50.0, 2: 25.0}
    wide = {str(r.cohort_month): r.asDict() for r in retention.cohort_matrix(df, "2017-01-01", "2017-04-30").collect()}
    assert wide["2017-01-01"].keys() == {"cohort_month", "month_0", "month_1", "month_2", "month_3"}
    assert wide["2017-01-01"]["month_2"] == 50.0 and wide["2017-02-01"]["month_2"] == 0.0


def test_cohort_without_month_zero_has_no_percentage(orders):
    df = orders(("a", "2017-01-05"), ("a", "2017-02-05"))
    rows = retention.cohort_retention(df, "2017-01-01", "2017-12-31").collect()
    assert [r.retention_pct for r in rows] == [100.0, 100.0]
    rows = retention.cohort_retention(df.filter("order_month > '2017-01-01'"), "2017-01-01").collect()
    assert [r.months_since_first for r in rows] == [0]


def test_churn_may_be_negative(orders):
    df = orders(("a", "2017-01-05"), ("a", "2017-02-05"), ("b", "2017-02-06"))
    row = retention.monthly_churn(df).first()
    assert (row.churn_rate, row.net_active_change_pct) == (-100.0, 100.0)


def test_review_writers(orders):
    df = orders(("a", "2017-01-05"), ("a", "2017-01-09"), ("b", "2017-01-05", {"score": None}))
    rows = {r.customer_type: r for r in retention.review_writers(df).collect()}
    assert rows["Review Writers"].repeat_rate == 100.0 and rows["Review Writers"].avg_lifetime_days == 4.0
    assert rows["Non-Review Writers"].customer_count == 1


def test_customer_key_may_name_the_person(orders):
    df = orders(("a", "2017-01-05"), ("b", "2017-01-09")).selectExpr("*", "'person' AS customer_unique_id")
    assert retention.retention_kpis(df).first().repeat_customers == 0
    assert retention.retention_kpis(df, customer_key="customer_unique_id").first().repeat_customers == 1


def test_zero_installments_fall_in_the_last_range(orders):
    df = orders(("a", "2017-01-05", {"parts": 0}), ("b", "2017-01-05", {"parts": 2}))
    rows = {r.installment_range: r for r in revenue.installments(df).collect()}
    assert rows["10+x"].working_capital_impact is None and rows["2-3x"].working_capital_impact == pytest.approx(5.0)
    groups = {r.installment_group for r in risk.installment_groups(df).collect()}
    assert groups == {"2-3x"}


def test_custom_order_follows_the_ladder(orders):
    df = orders(*[("a", "2017-01-05", {"value": x}) for x in ("600.00", "40.00", "150.00", "60.00")])
    labels = [r.order_value_range for r in executive.order_value_distribution(df).collect()]
    assert labels == ["< R$ 50", "R$ 50-100", "R$ 100-200", "R$ 500+"]


def test_state_growth_needs_both_years(orders):
    df = orders(
        ("a", "2017-01-05"), ("a", "2018-01-05", {"value": "25.00"}), ("b", "2017-01-05", {"state": "RJ"}),
    )
    rows = geography.state_growth(df, "2017-01-01", "2018-12-31").collect()
    assert [(r.customer_state, r.revenue_growth_pct, r.orders_growth_pct) for r in rows] == [("SP", 150.0, 0.0)]


def test_small_states_are_left_out(orders):
    df = orders(*[("a", "2017-01-05")] * 3, ("b", "2017-01-05", {"state": "RJ"}))
    assert [r.customer_state for r in delivery.state_delivery(df, min_orders=2).collect()] == ["SP"]


def test_peaks_take_the_first_of_a_tie(orders):
    df = orders(("a", "2017-01-02"), ("a", "2017-01-01"))
    rows = {r.peak: r.value for r in timing.peaks(df).collect()}
    assert rows == {"day_of_week": "Sunday", "month": "January", "hour": "0"}


def test_period_bounds_are_inclusive_and_optional(orders):
    df = orders(("a", "2017-01-01"), ("a", "2017-01-31"), ("a", "2017-02-01"))
    assert risk.cancellation_kpis(df, "2017-01-01", "2017-01-31").first().total_orders == 2
    assert risk.cancellation_kpis(df, end="2017-01-30").first().total_orders == 1
    assert risk.cancellation_kpis(df).first().total_orders == 3


def test_score_distribution(frame):
    rows = everyday.score_distribution(frame([(5,), (5,), (1,), (None,)], "review_score int")).collect()
    assert [(r.review_score, r.percentage) for r in rows] == [(5, 50.0), (1, 25.0), (None, 25.0)]
