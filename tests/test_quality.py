"""Each check returns exactly the row that breaks it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bazarlytics.plans.warehouse import retail_warehouse
from bazarlytics.quality import business, checks, profile, suite


@pytest.fixture
def tables(frame):
    return {
        "a": frame(
            [(1, "x", 5.0, "SP", "01037"), (2, "x", -1.0, "ZZ", "1037"), (3, None, None, "RJ", "00999"), (3, "y", 120.0, None, None)],
            "id int, kind string, amount double, state string, zip string",
        ),
        "parent": frame([(1,), (2,)], "key int"),
        "empty": frame([], "id int"),
    }


@pytest.mark.parametrize("check, ids", [
    (checks.not_null("a", "kind"), [3]),
    (checks.accepted_values("a", "kind", ["x"]), [3]),
    (checks.accepted_range("a", "amount", 0), [2]),
    (checks.accepted_range("a", "amount", 5, None, inclusive=False), [1, 2]),
    (checks.values_between("a", "amount", 0, 100), [2, 3]),
    (checks.values_between("a", "amount", 0, 120, strictly=True, where="kind = 'y'"), [3]),
    (checks.values_in_set("a", "kind", ["y"], where="id < 2"), [1]),
    (checks.expression_is_true("a", "positive", "amount > 0"), [2]),
    (checks.pair_ordered("a", "amount", "id"), [2]),
    (checks.relationships("a", "id", "parent", "key"), [3, 3]),
    (checks.unique("a", "id"), [3]),
    (checks.unique("a", "id", "kind"), []),
])
def test_failing_rows(tables, check, ids):
    assert sorted(r.id for r in check.failing(tables).collect()) == ids


@pytest.mark.parametrize("check, fails", [
    (checks.row_count_between("a", 1, 3), True), (checks.row_count_between("a", 4, 4), False),
    (checks.at_least_one("a", "id"), False), (checks.at_least_one("empty", "id"), True),
])
def test_totals(tables, check, fails):
    assert check.failing(tables).count() == fails


def test_recency_and_freshness(frame):
    df = frame([(dt.datetime(2018, 1, 1),), (None,)], "at timestamp_ntz")
    for as_of, stale in (("2018-01-31", 0), ("2018-02-02", 1)):
        assert checks.recency("t", "at", 30, as_of).failing({"t": df}).count() == stale
    states = [checks.freshness(df, "t", "at", 10, 20, d).first().status for d in ("2018-01-11", "2018-01-12", "2018-01-22")]
    assert states == ["pass", "warn", "error"]
    assert checks.freshness(df.filter("at is null"), "t", "at", 10, 20, "2018-01-01").first().status == "error"


def test_invalid_values(tables, frame):
    a = tables["a"]
    assert [r.invalid_state for r in checks.invalid_states(a, "state").collect()] == ["ZZ"]
    assert sorted(r.invalid_zip for r in checks.invalid_zip_prefixes(a, "zip").collect()) == ["00999", "1037"]
    assert sorted(r.invalid_percentage for r in checks.invalid_percentages(a, "amount").collect()) == [-1.0, 120.0]
    days = frame([(dt.date(2015, 1, 1),), (dt.date(2015, 1, 1),), (dt.date(2017, 1, 1),)], "d date")
    assert [tuple(r) for r in checks.invalid_dates(days, "d", "2016-01-01", "2019-12-31").collect()] == [(dt.date(2015, 1, 1), 2)]


def test_value_checks_are_errors_by_default(tables):
    chosen = [
        checks.valid_state("a", "state"), checks.valid_zip_prefix("a", "zip"), checks.percentage_range("a", "amount"),
        checks.percentage_range("a", "id", severity="warn"),
    ]
    results = {r.name: (r.severity, r.failures) for r in checks.run_checks(chosen, tables).collect()}
    assert results == {
        "valid_state_a_state": ("error", 1), "valid_zip_prefix_a_zip": ("error", 2), "percentage_range_a_amount": ("error", 2),
        "percentage_range_a_id": ("warn", 0),
    }


def test_text_literals_are_quoted(frame):
    t = {"q": frame([("a'b",), ("c\\d",), ("x",)], "v string")}
    assert [r.v for r in checks.accepted_values("q", "v", ["a'b", "c\\d"]).failing(t).collect()] == ["x"]


def test_schema_checks(tables):
    a = tables["a"]
    assert checks.type_mismatch(a, "id", "int").count() == 0 and checks.type_mismatch(a, "id", "string").count() == 1
    assert checks.columns_match(a, a.columns).count() == 0
    wrong = checks.columns_match(a, ["id", "amount", "kind", "state"]).collect()
    assert [(r.position, r.expected, r.actual) for r in wrong] == [(2, "amount", "kind"), (3, "kind", "amount"), (5, None, "zip")]


def test_aggregate_equals(tables):
    a, p = tables["a"], tables["parent"]
    assert checks.aggregate_equals(a, "sum(id)", p, "sum(key)").count() == 1
    assert checks.aggregate_equals(a, "sum(id)", p, "sum(key)", tolerance=6).count() == 0


def test_run_and_store(tables, tmp_path, spark):
    chosen = [
        checks.not_null("a", "kind", severity="error", tags=("core",)), checks.not_null("a", "id"), checks.unique("a", "id"),
        checks.row_count_between("a", 0, 9),
    ]
    results = checks.run_checks(chosen, tables)
    assert {r.name: (r.failures, r.status) for r in results.collect()} == {
        "not_null_a_kind": (1, "fail"), "not_null_a_id": (0, "pass"), "unique_a_id": (1, "warn"), "row_count_a": (0, "pass"),
    }
    totals = profile.result_totals(results).first()
    assert (totals.checks, totals.passed, totals.errors, totals.warnings, totals.pass_rate) == (4, 2, 1, 1, 50.0)
    assert {r.status: r.percentage for r in profile.status_summary(results).collect()} == {"pass": 50.0, "fail": 25.0, "warn": 25.0}
    assert [r.name for r in profile.failing_checks(results).collect()] == ["not_null_a_kind", "unique_a_id"]
    slow = results.withColumn("seconds", F.length("name").cast("double"))
    assert profile.slowest_checks(slow, 1).first().name == "not_null_a_kind"
    path = checks.store_failures(chosen[0], tables, str(tmp_path))
    assert path.endswith("test_failures/not_null_a_kind") and spark.read.parquet(path).count() == 1
    assert checks.select(chosen, "core") == [chosen[0]] and len(checks.select(chosen, severity="warn")) == 3
    with pytest.raises(ValueError):
        checks.run_checks([chosen[0], chosen[0]], tables)


def test_row_rules_of_a_table_share_one_scan(tables):
    chosen = [checks.not_null("a", c) for c in ("id", "kind", "amount")] + [checks.row_count_between("a", 0, 9)]
    plan = checks.failure_counts(chosen, tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1


def test_suite_selection():
    names = [c.name for c in suite.all_checks()]
    assert len(names) == len(set(names)) and len(names) > 260
    marts = checks.select(suite.all_checks(), *suite.SELECTORS["mart_tests"])
    assert marts and all(c.table.startswith("mart_") for c in marts)
    assert len(checks.select(suite.all_checks(), *suite.SELECTORS["full_suite"])) == len(names)


def facts(frame, **rows):
    schemas = {
        "fct_order_items": "order_id string, product_category_name string, seller_id string, product_id string, item_price decimal(10,2), freight_value decimal(10,2), total_item_value decimal(10,2), order_date_key int",
        "dim_category": "product_category_name string, total_orders long, total_items_sold long, total_revenue decimal(20,2)",
        "dim_sellers": "seller_id string, total_orders long, total_items_sold long, total_revenue decimal(20,2)",
        "dim_products": "product_id string, product_category_name string, total_revenue decimal(20,2)",
        "fct_payments": "order_id string, payment_value decimal(10,2), order_date_key int",
        "fct_reviews": "review_id string, order_id string, review_score int, review_sentiment string, order_status string, review_creation_date timestamp_ntz, order_purchase_timestamp timestamp_ntz, review_date_key int, order_date_key int",
        "dim_date": "date_key int",
        "fct_orders": "order_id string, customer_id string, total_order_value decimal(20,2), total_payment_value decimal(20,2), review_score int, order_status string, item_count long, delivery_performance string, days_vs_estimated double",
        "stg_orders": "order_id string, order_status string, order_purchase_timestamp timestamp_ntz, order_approved_at timestamp_ntz, order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz",
        "dim_geography": "zip_code_prefix string, city string, state string, customer_count long, seller_count long, total_entities long, location_type string",
        "mart_executive_dashboard_fanout_safe": "total_revenue double",
    }
    return {name: frame(rows.get(name, []), schema) for name, schema in schemas.items()}


def test_reconciliation_and_references(frame):
    from decimal import Decimal as D

    t = facts(
        frame,
        fct_order_items=[("o1", "cat", "s1", "p1", D(-1), D(2), D(1), 20180101), ("o2", "cat", "s2", "p2", D(5), D(-2), D(3), 20190101)],
        dim_category=[("cat", 2, 2, D(9)), ("unsold", 0, 0, D(0))],
        dim_sellers=[("s1", 2, 1, D(-1)), ("s2", 1, 1, D(5))],
        dim_products=[("p1", "cat", D(0)), ("p2", "other", D(0)), ("p3", "cat", D(-4))],
        fct_payments=[("o1", D(7), 20180101), ("o9", D(-7), None)],
        dim_date=[(20180101,)],
        mart_executive_dashboard_fanout_safe=[(4.0,)],
    )
    assert [r.issue_type for r in business.category_metrics(t).collect()] == ["Revenue mismatch"]
    assert [(r.seller_id, r.issue_type) for r in business.seller_metrics(t).collect()] == [("s1", "Orders mismatch")]
    assert [tuple(r) for r in business.missing_date_keys(t).collect()] == [(20190101, "fct_order_items")]
    assert sorted((r.table_name, r.column_name) for r in business.negative_values(t).collect()) == [
        ("dim_products", "total_revenue"), ("dim_sellers", "total_revenue"), ("fct_order_items", "freight_value"),
        ("fct_order_items", "item_price"), ("fct_payments", "payment_value"),
    ]
    assert [(r.order_id, r.difference) for r in business.items_against_payments(t).collect()] == [("o1", D(6))]
    assert sorted(r.product_id for r in business.product_categories(t).collect()) == ["p2", "p3"]
    assert business.executive_revenue(t).count() == 0


def test_row_level_business_rules(frame):
    from decimal import Decimal as D

    day = dt.datetime(2018, 1, 2)
    before = day - dt.timedelta(days=1)
    t = facts(
        frame,
        fct_reviews=[
            ("r1", "o1", 5, "negative", "delivered", day, before, 1, 1), ("r2", "o2", 2, "negative", None, before, day, 1, 1),
            ("r3", "o3", 3, "neutral", "processing", day, day, 1, 1),
        ],
        fct_orders=[
            ("o1", None, D(10), D(10), 6, "delivered", 0, "early", 1.0), ("o2", "c", D(10), D(9), None, "canceled", 0, "late", 1.0),
            ("o3", "c", D(0), D(9), 0, "created", 2, "on_time", 0.0),
        ],
        stg_orders=[
            ("o1", "delivered", day, before, day, day), ("o2", "delivered", day, day, before, day),
            ("o3", "delivered", before, day, before, day), ("o4", "delivered", before, None, day, day),
        ],
        dim_geography=[("1", "a", "b", 0, 0, 0, "Unknown"), ("2", "a", "b", 1, 0, 1, "Both"), ("3", "a", "b", 1, 1, 2, "Both")],
    )

    def ids(df, key="order_id"):
        return sorted(r[key] for r in df.collect())

    assert ids(business.sentiment_mismatch(t), "review_id") == ["r1"]
    assert ids(business.reviews_before_purchase(t), "review_id") == ["r2"]
    assert ids(business.reviews_of_unfulfilled_orders(t), "review_id") == ["r2", "r3"]
    assert ids(business.orders_without_customer(t)) == ["o1"]
    assert ids(business.order_payment_mismatch(t)) == ["o2"]
    assert ids(business.invalid_scores(t)) == ["o1", "o3"]
    assert ids(business.orders_without_items(t)) == ["o1"]
    assert ids(business.performance_mismatch(t)) == ["o1"]
    assert {r.order_id: r.issue_type for r in business.delivery_dates_out_of_order(t).collect()} == {
        "o1": "Approved before purchase", "o2": "Delivered before purchase", "o3": "Delivered before approval",
    }
    assert ids(business.geography_without_entities(t), "zip_code_prefix") == ["1", "2"]


@pytest.fixture(scope="module")
def observed_warehouse(spark):
    shop = retail_warehouse(spark, "/root/testdata/sf0.001", checks=suite.all_checks("2001-12-31"))
    shop.build()
    return shop


def test_counts_observed_in_the_write_equal_a_scan(observed_warehouse):
    shop = observed_warehouse
    chosen = [c for c in suite.all_checks("2001-12-31") if c.rows is None and not c.table.startswith("raw_")]
    plain = {name: shop[name] for name in {c.table for c in chosen}}
    scanned = {r.name: r.failures for r in checks.failure_counts(chosen, plain).collect()}
    assert len(scanned) > 150 and any(scanned.values())
    assert {r.name: r.failures for r in shop.observed_checks().collect()} == scanned == shop.observed


def test_observed_rules_need_no_scan(observed_warehouse):
    chosen = [c for c in suite.all_checks("2001-12-31") if c.rows is None and c.table.startswith("fct_")]
    plan = checks.failure_counts(chosen, observed_warehouse)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan


def test_all_key_rules_share_one_shuffle(observed_warehouse):
    keyed = [c for c in suite.all_checks() if c.keys and not c.table.startswith("raw_")]
    plan = checks.key_failures(keyed, observed_warehouse)._jdf.queryExecution().executedPlan().toString()
    scans = plan.count("FileScan parquet")
    assert scans <= len({t for c in keyed for t in (c.table, c.parent[0] if c.parent else c.table)}) < len(keyed)
    assert plan.count("hashpartitioning(space#") <= 2 + 1


def test_key_rules_against_each_by_itself(frame):
    schema = "a int, b string, c long"
    child = [(1, "x", 1), (1, "x", 1), (None, "x", 7), (5, None, 7), (5, "1:x", None), (9, "x", 2)]
    tables = {
        "child": frame(child, schema),
        "parent": frame([(1, "y", 1), (1, "y", 1), (2, None, 5), (None, "x", 2)], schema),
        "none": frame([], schema),
    }
    chosen = [
        checks.unique("child", "a"), checks.unique("child", "a", "b"), checks.unique("child", "a", "b", "c"),
        checks.unique("parent", "a"), checks.unique("none", "a"),
        checks.relationships("child", "a", "parent", "a"), checks.relationships("child", "c", "parent", "c"),
        checks.relationships("child", "b", "none", "b"), checks.relationships("none", "a", "parent", "c"),
        checks.relationships("parent", "c", "parent", "a"),
    ]
    want = {c.name: c.failing(tables).count() for c in chosen}
    got = {r.name: r.failures for r in checks.key_failures(chosen, tables).collect()}
    assert got == want and sum(map(bool, want.values())) >= 6


def test_timed_checks_agree_and_carry_seconds(frame):
    tables = {"t": frame([(1, None), (1, "x")], "a int, b string")}
    chosen = [checks.unique("t", "a"), checks.not_null("t", "b", severity="error"), checks.valid_state("t", "b")]
    timed = checks.timed_checks(chosen, tables)
    assert {tuple(r)[:4] for r in timed.collect()} == {tuple(r) for r in checks.run_checks(chosen, tables).collect()}
    assert all(r.seconds > 0 for r in timed.collect())
    assert [r.name for r in profile.slowest_checks(timed, 1).collect()]


def test_hot_key_is_counted_before_the_shuffle(spark):
    rows = spark.range(200_000).selectExpr("if(id % 3 = 0, 7, id) AS k", "id AS v")
    tables = {"t": rows, "p": spark.range(100).selectExpr("id AS k")}
    chosen = [checks.unique("t", "k"), checks.relationships("t", "k", "p", "k")]
    got = {r.name: r.failures for r in checks.key_failures(chosen, tables).collect()}
    known = 66_667 + sum(1 for i in range(100) if i % 3 and i != 7) + 1
    assert got == {"unique_t_k": 1, "relationships_t_k": 200_000 - known}
