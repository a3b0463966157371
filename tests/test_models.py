"""Models on small literal tables, where every branch can be seen."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bazarlytics.plans import dimensions, intermediate, marts, staging
from bazarlytics.plans.warehouse import Warehouse, retail_warehouse
from bazarlytics.sources.schemas import RAW

DAY = dt.datetime(2018, 3, 10, 9, 30)


def at(days=0, hours=0):
    return DAY + dt.timedelta(days=days, hours=hours)


@pytest.fixture
def shop(spark, tmp_path):
    """A function from rows per raw table to a warehouse."""

    def make(**rows):
        raw = {t: (lambda t=t: spark.createDataFrame(rows.get(t, []), RAW[t])) for t in RAW}
        return Warehouse(spark, raw, str(tmp_path / "warehouse"))

    return make


def order(n, customer="c1", status="delivered", days=0, arrived=5, due=10):
    return (
        f"o{n}", customer, status, at(days), at(days, 2), at(days + 1),
        None if arrived is None else at(days + arrived), at(days + due),
    )


CUSTOMERS = [("c1", "u1", "01037", "sao paulo", "SP"), ("c2", "u2", "20000", "rio", "rj ")]
SELLERS = [("s1", "01037", "sao paulo", "SP"), ("s2", "99999", "nowhere", "XX")]


def item(o, n=1, product="p1", seller="s1", price="100.00", freight="10.00"):
    return (f"o{o}", n, product, seller, at(3), Decimal(price), Decimal(freight))


def pay(o, n=1, kind="credit_card", parts=3, value="110.00"):
    return (f"o{o}", n, kind, parts, Decimal(value))


def review(o, n=1, score=5, message=None, days=12, answer=None):
    return (f"r{o}_{n}", f"o{o}", score, None, message, at(days), answer)


PRODUCTS = [("p1", "cat_a", 10, 100, 1, *[Decimal("10")] * 4), ("p2", None, None, None, None, *[None] * 4)]
CATEGORIES = [("cat_a", "bed_bath_table"), ("cat_b", "la_cuisine")]


@pytest.mark.parametrize("arrived, label, days", [(9, "early", -1.0), (10, "on_time", 0.0), (12, "late", 2.0), (None, None, None)])
def test_delivery_performance(shop, arrived, label, days):
    row = shop(orders=[order(1, arrived=arrived)])["stg_orders"].first()
    assert (row.delivery_performance, row.days_vs_estimated) == (label, days)
    assert row.hours_to_approval == 2.0 and row.order_month == dt.date(2018, 3, 1)


def test_staging_drops_rows_without_key(shop):
    lost = (None, *order(2)[1:])
    assert shop(orders=[order(1), lost])["stg_orders"].count() == 1


def test_product_completeness(shop):
    rows = {r.product_id: r for r in shop(products=PRODUCTS)["stg_products"].collect()}
    assert rows["p1"].product_completeness_score == 4 and rows["p2"].product_completeness_score == 0
    assert rows["p1"].product_volume_cm3 == 1000 and rows["p2"].product_volume_cm3 is None


def test_payment_summary_prefers_the_smallest_tied_type(shop):
    w = shop(payments=[pay(1, 1, "voucher", 1, "5.00"), pay(1, 2, "boleto", None, "7.00")])
    row = w["int_order_payments_aggregated"].first()
    assert (row.primary_payment_method, row.payment_method_count) == ("boleto", 2)
    assert (row.max_installments, row.avg_installments, row.used_installments) == (1, 1.0, False)
    assert row.voucher_value == Decimal("5.00") and row.credit_card_value == 0


def test_two_reviews_give_two_order_rows_unless_deduplicated(shop):
    w = shop(orders=[order(1)], customers=CUSTOMERS, reviews=[review(1, 1, 5), review(1, 2, 1, days=20)])
    assert w["fct_orders"].count() == 2
    latest = intermediate.int_orders_enriched(
        w["stg_orders"], w["stg_customers"], w["stg_reviews"], dedup_reviews=True
    ).first()
    assert latest.review_id == "r1_2" and latest.review_score == 1


def test_order_without_items_or_payments(shop):
    row = shop(orders=[order(1, status="created", arrived=None)], customers=CUSTOMERS)["fct_orders"].first()
    assert (row.item_count, row.total_order_value, row.avg_item_price) == (0, 0, 0.0)
    assert row.used_credit_card is None and row.is_delivered is False and row.is_positive_review is False


def test_item_signs_and_flags(shop):
    w = shop(
        orders=[order(1, arrived=8), order(2, status="shipped")], customers=CUSTOMERS, sellers=SELLERS,
        products=PRODUCTS, category_translation=CATEGORIES,
        order_items=[item(1), item(2, seller="s2", price="0.00")],
    )
    rows = {r.order_id: r for r in w["fct_order_items"].collect()}
    assert rows["o1"].days_vs_estimated == 2 and rows["o1"].days_to_deliver == 8
    assert rows["o1"].is_same_state and rows["o1"].is_same_city and rows["o1"].is_on_time_delivery
    assert rows["o2"].is_on_time_delivery is None and rows["o2"].freight_percentage is None
    assert rows["o1"].freight_percentage == 10.0 and rows["o1"].price_tier == "High"


def test_review_details(shop):
    w = shop(orders=[order(1)], reviews=[
        review(1, 1, 4, "x" * 60, days=6, answer=at(6, 20)), review(1, 2, 3, None, days=40), review(9, 1, 2, "short"),
    ])
    rows = {r.review_id: r for r in w["fct_reviews"].collect()}
    assert (rows["r1_1"].comment_detail_level, rows["r1_1"].review_timing) == ("Moderate", "Immediate")
    assert (rows["r1_1"].answer_timing, rows["r1_2"].answer_timing) == ("Same/Next Day", "No Answer")
    assert rows["r1_2"].review_timing == "After Month" and rows["r9_1"].review_timing == "Unknown"
    assert rows["r9_1"].customer_id is None and rows["r9_1"].order_value == 0


def test_customer_segments_and_recency(shop):
    w = shop(orders=[order(1), order(2, days=3), order(3, days=9)], customers=CUSTOMERS)
    rows = {r.customer_id: r for r in dimensions.dim_customers(w["stg_customers"], w["fct_orders"], "2018-04-01").collect()}
    assert (rows["c1"].customer_segment, rows["c1"].days_since_last_order) == ("Repeat Customer", 13)
    assert (rows["c2"].customer_segment, rows["c2"].days_since_last_order) == ("No Orders", None)
    assert rows["c2"].customer_state_clean == "RJ"
    default = {r.customer_id: r.days_since_last_order for r in w["dim_customers"].collect()}
    assert default == {"c1": 0, "c2": None}


def test_geography_kinds(shop):
    w = shop(customers=CUSTOMERS, sellers=SELLERS, geolocation=[
        ("01037", Decimal("-23.5"), Decimal("-46.6"), "b", "SP"), ("01037", Decimal("-23.7"), Decimal("-46.8"), "a", "SP"),
    ])
    rows = {r.zip_code_prefix: r for r in w["dim_geography"].collect()}
    assert {z: r.location_type for z, r in rows.items()} == {"01037": "Both", "20000": "Customer Only", "99999": "Seller Only"}
    assert rows["01037"].latitude == pytest.approx(-23.6) and rows["01037"].state_name == "São Paulo"
    assert rows["99999"].region == "Unknown" and rows["99999"].state_name == "XX" and not rows["99999"].has_coordinates


def test_calendar(shop):
    w = shop(orders=[order(1, days=-69), order(2, days=300)])
    rows = {r.date_day: r for r in w["dim_date"].collect()}
    new_year = rows[dt.date(2018, 1, 1)]
    assert new_year.is_holiday and new_year.holiday_name == "New Year's Day" and new_year.is_year_start
    assert rows[dt.date(2018, 3, 31)].is_quarter_end and rows[dt.date(2018, 12, 31)].is_year_end
    assert rows[dt.date(2018, 3, 11)].day_of_week == 0 and rows[dt.date(2018, 3, 11)].is_weekend
    assert len(rows) == 370 and new_year.quarter_name == "2018-Q1" and new_year.date_key == 20180101


def executive_shop(shop):
    """One order with two lines, a primary payment and two reviews; another without any."""
    return shop(
        orders=[order(1, arrived=10), order(2, customer="c2", status="canceled", arrived=None, days=2)],
        customers=CUSTOMERS, sellers=SELLERS, products=PRODUCTS, category_translation=CATEGORIES,
        order_items=[item(1, 1), item(1, 2, product="p2", seller="s2", price="40.00")],
        payments=[pay(1, 1), pay(1, 2, "voucher", 1, "50.00")],
        reviews=[review(1, 1, 5), review(1, 2, 2)],
    )


def test_executive_fan_out(shop):
    days = {r.date_day.day: r for r in executive_shop(shop)["mart_executive_dashboard"].collect()}
    first, gap_day, last = days[10], days[11], days[12]
    # two order rows, each repeated by two lines, one primary payment and two reviews
    assert first.total_revenue == pytest.approx(160.0 * 8) and first.total_items == 16
    assert first.total_orders == 1 and first.avg_order_value == 160.0 and first.avg_review_score == 3.5
    assert (first.total_reviews, first.positive_reviews, first.negative_reviews) == (2, 1, 1)
    assert (first.unique_sellers, first.unique_products, first.credit_card_orders) == (2, 2, 1)
    assert first.on_time_deliveries == 1 and first.installment_usage_rate == 100.0
    assert gap_day.total_orders == 0 and gap_day.total_revenue is None and gap_day.delivery_rate is None
    assert last.canceled_orders == 1 and last.total_revenue == 0 and last.cancellation_rate == 100.0
    assert last.ytd_orders == 2 and last.ma7_orders == pytest.approx(2 / 3)


def test_executive_without_fan_out(shop):
    w = executive_shop(shop)
    first = min(w["mart_executive_dashboard_fanout_safe"].collect(), key=lambda r: r.date_day)
    assert first.total_revenue == pytest.approx(160.0) and first.total_items == 2
    assert first.avg_review_score == 3.5 and first.total_payments == pytest.approx(160.0)


def test_seller_and_product_marts(shop):
    w = executive_shop(shop)
    sellers = {r.seller_id: r for r in w["mart_seller_scorecard"].collect()}
    assert sellers["s1"].revenue_percentile == 100.0 and sellers["s2"].revenue_percentile == 0.0
    assert sellers["s1"].same_state_order_rate == 100.0 and sellers["s1"].geographic_focus == "Local Focused"
    assert sellers["s1"].top_category == "bed_bath_table" and sellers["s2"].top_category is None
    assert sellers["s2"].product_diversity_type == "Generalist" and sellers["s1"].price_stddev is None
    products = {r.product_id: r for r in w["mart_product_performance"].collect()}
    assert products["p1"].total_reviews == 2 and products["p1"].avg_review_score == 3.5
    assert products["p1"].performance_score == pytest.approx((0.5 + 35) / 10)
    assert products["p2"].category_group is None and products["p1"].primary_seller_id == "s1"


def test_customer_mart(shop):
    w = executive_shop(shop)
    rows = {r.customer_id: r for r in w["mart_customer_analytics"].collect()}
    # two review rows of one order: totals weigh both, counts take the order once
    assert rows["c1"].total_orders == 1 and rows["c1"].lifetime_value == Decimal("320.00")
    assert rows["c1"].favorite_category == "bed_bath_table" and rows["c1"].unique_products_purchased == 1
    assert rows["c1"].on_time_delivery_rate == 100.0 and rows["c1"].avg_days_between_orders is None
    assert rows["c2"].value_tier == "No Orders" and rows["c2"].lifecycle_stage == "Active New"


@pytest.mark.parametrize("scores, label", [
    ((5, 4, 4), "Champions"), ((3, 3, 5), "Loyal Customers"), ((5, 2, 5), "New Customers"), ((2, 3, 1), "At Risk"),
    ((1, 2, 5), "Lost"), ((3, 1, 4), "Big Spenders"), ((3, 1, 1), "Regular"), ((None, None, None), "Regular"),
])
def test_rfm_segments(frame, scores, label):
    df = frame([scores], "r int, f int, m int").select(marts.rfm_segment("r", "f", "m").alias("s"))
    assert df.first().s == label


@pytest.mark.parametrize("orders, recency, label", [
    (0, None, "Never Purchased"), (3, 90, "Active Repeat"), (1, 90, "Active New"), (1, 180, "Cooling Down"), (5, 365, "At Risk"), (5, 366, "Dormant"),
])
def test_lifecycle(frame, orders, recency, label):
    df = frame([(orders, recency)], "o int, r int").select(marts.lifecycle_stage("o", "r").alias("s"))
    assert df.first().s == label


@pytest.mark.parametrize("score, kept, recent, label", [
    (4.5, 90.0, 1, "Excellent"), (4.5, 90.0, 0, "Average"), (4.0, 80.0, 1, "Good"), (3.5, 70.0, 0, "Average"),
    (3.4, 99.0, 1, "Needs Improvement"), (5.0, 69.0, 1, "Needs Improvement"), (None, None, None, "New/Unknown"), (4.9, None, 1, "New/Unknown"),
])
def test_seller_health(frame, score, kept, recent, label):
    df = frame([(score, kept, recent)], "avg_review_score double, on_time_delivery_rate double, last_90 int")
    assert df.select(marts.seller_health().alias("h")).first().h == label


def test_staging_models_cover_all_sources():
    assert {source for _, source in staging.MODELS.values()} == set(RAW)


@pytest.mark.parametrize("name, table", [
    ("mart_product_performance", "fct_order_items"), ("mart_seller_scorecard", "fct_order_items"), ("dim_sellers", "stg_order_items"),
])
def test_lines_are_read_once_beside_stored_subtotals(spark, name, table):
    shop = retail_warehouse(spark, "/root/testdata/sf0.001")
    plan = shop.plan(name)._jdf.queryExecution().optimizedPlan()
    read = [str(leaf) for leaf in _leaves(plan)]
    lines = shop[table].columns
    subtotals = [r for r in read if "lines#" in r]
    assert sum(lines[0] + "#" in r and "order_item_id#" in r for r in read) <= 2 and len(subtotals) >= 1


def _leaves(plan):
    found = plan.collectLeaves()
    return [found.apply(i).output().toString() for i in range(found.size())]


@pytest.mark.parametrize("key, stored", [("product_id", "product_order_subtotals"), ("seller_id", "seller_order_subtotals")])
def test_subtotals_merge_to_the_totals_of_the_lines(spark, key, stored):
    shop = retail_warehouse(spark, "/root/testdata/sf0.001")
    shop["mart_product_performance"], shop["mart_seller_scorecard"]
    lines, parts = shop["fct_order_items"], shop._stored[stored]
    want = lines.groupBy(key).agg(
        F.count("*").alias("n"), F.countDistinct("order_id").alias("orders"), F.sum("item_price").alias("revenue"),
        F.min("item_price").alias("low"), F.max("order_purchase_timestamp").alias("last"), F.countDistinct("customer_state").alias("states"),
    )
    got = parts.groupBy(key).agg(
        F.sum("lines").alias("n"), F.count("order_id").alias("orders"), F.sum("price_sum").alias("revenue"),
        F.min("min_price").alias("low"), F.max("bought_last").alias("last"), F.countDistinct("customer_state").alias("states"),
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
