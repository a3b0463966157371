"""Tables in buckets of their key are not shuffled again, and give the rows they gave before."""

import re

import pytest
from pyspark.sql import functions as F

from bazarlytics.operators.grouping import has_hot_key
from bazarlytics.plans import dimensions, facts, intermediate, marts
from bazarlytics.plans.warehouse import retail_warehouse
from bazarlytics.quality import business
from bazarlytics.sources import files
from tests.test_narrow_lines import enriched_inputs, rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shop(spark):
    return retail_warehouse(spark, FOLDER)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def moved(df):
    """The keys of the exchanges in a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"Exchange hashpartitioning\((.*), \d+\)", plan)]


def test_a_bucketed_table_is_summed_and_joined_in_place(spark, tmp_path, no_broadcast):
    df = spark.range(900).select(F.concat(F.lit("o"), F.col("id") % 90).alias("order_id"), (F.col("id") % 7).alias("p"))
    a, b = (files.write_table(df, str(tmp_path / n), bucket_by="order_id") for n in "ab")
    assert rows(a) == rows(df) == rows(spark.read.parquet(str(tmp_path / "a")))
    summed = a.groupBy("order_id", "p").count().join(b.distinct(), ["order_id", "p"])
    assert moved(summed) == [] and summed.agg(F.sum("count")).first()[0] == 900


def test_a_table_with_a_hot_bucket_is_read_without_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "HOT_BYTES", 100)
    df = spark.range(20_000).select(F.lit("o1").alias("order_id"), F.md5(F.col("id").cast("string")).alias("x"))
    table = files.write_table(df, str(tmp_path / "t"), bucket_by="order_id")
    assert moved(table.groupBy("order_id").agg(F.min("x"))) == ["order_id"] and table.count() == 20_000


def test_hot_keys_are_told(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"))
    assert has_hot_key(df, "k", most_rows=100) and not has_hot_key(df, "k", most_rows=400)
    assert not has_hot_key(df.where("k is null"), "k", most_rows=1)


def test_facts_meet_their_orders_in_place(shop, no_broadcast):
    assert set(moved(shop.plan("fct_order_items"))) <= {"product_id", "order_id", "product_category_name", "seller_id"}
    for name in ("stg_orders", "stg_order_items", "fct_reviews", "fct_payments"):
        shop[name]
    before = moved(intermediate.order_context(shop["stg_orders"], shop._stored["order_places"]))
    assert before == []


def test_a_product_s_lines_move_once_for_its_totals(shop, no_broadcast):
    shop["mart_product_performance"]
    sales = marts._basket_totals(marts.unfolded(shop._stored["product_order_subtotals"]), "product_id")
    reach = marts._reach(shop._stored["product_order_subtotals"], "product_id")
    assert moved(sales.join(reach, "product_id")) == []


@pytest.mark.parametrize("hot", [True, False])
@pytest.mark.parametrize("key", ["product_id", "seller_id"])
def test_unfolded_subtotals_hold_every_measure(shop, key, hot):
    items = shop["fct_order_items"].unionByName(shop["fct_order_items"].limit(500))  # orders with several lines of a key
    items = items.withColumn("item_price", F.when(F.col("order_item_id") != 2, F.col("item_price")))
    items = items.withColumn("freight_percentage", F.when(F.col("item_price") > 0, F.col("freight_value").cast("double") / F.col("item_price").cast("double") * 100.0))
    got = marts.unfolded(marts.order_subtotals(items, key, hot)).select(
        key, "order_id", "lines", "price_n", F.col("price_squares").cast("double"), "max_price", "bought", F.round("share_sum", 6), "share_n", "delivered", "same_state",
    )
    want = items.groupBy(key, "order_id").agg(
        F.count("*"), F.count("item_price"), F.sum(F.col("item_price") * F.col("item_price")).cast("double"), F.max("item_price"),
        F.min("order_purchase_timestamp"), F.round(F.sum("freight_percentage"), 6), F.count("freight_percentage"),
        F.bool_or("is_delivered"), F.bool_or("is_same_state"),
    )
    assert sorted(map(lambda r: str(tuple(r)), got.collect())) == sorted(map(lambda r: str(tuple(r)), want.collect()))


def test_carried_products_and_places_are_the_joined_rows(spark, frame):
    items, products, sellers, categories, context = enriched_inputs(spark)
    for some in (products, products.unionByName(products)):  # a product listed twice repeats its lines
        plain = facts.fct_order_items(intermediate.lines_in_context(items, some, sellers, categories, context))
        carried = intermediate.order_products(items, some)
        narrow = facts.fct_order_items(intermediate.lines_in_context(items, some, sellers, categories, context, carried))
        assert rows(narrow) == rows(plain)
    customers = frame([("c1", "z1", "x", "sp"), ("c1", "z2", "y", "rj"), (None, "z3", "y", "rj")], "customer_id string, customer_zip_code_prefix string, customer_city string, customer_state string")
    orders = frame([("o1", "c1"), ("o1", "c1"), ("o2", None), ("o3", "c9")], "order_id string, customer_id string")
    placed = orders.join(intermediate.order_places(orders, customers), ["order_id", "customer_id"], "left")
    assert rows(placed.select("order_id", "customer_zip_code_prefix")) == rows(orders.join(customers, "customer_id", "left").select("order_id", "customer_zip_code_prefix"))


def test_categories_are_sold_alike_with_and_without_the_stored_fact(spark):
    shop = retail_warehouse(spark, FOLDER)
    alone = shop.plan("dim_category").collect()
    shop["fct_order_items"]
    assert sorted(map(str, shop.plan("dim_category").collect())) == sorted(map(str, alone))


def test_orders_are_counted_once_per_product(frame):
    products = frame([("p1", "a")], "product_id string, product_category_name string").withColumns(
        {c: F.lit(1) for c in ("product_completeness_score", "product_volume_cm3", "product_weight_g")}
    )
    categories = frame([("a", "b", "b")], "product_category_name string, product_category_name_english string, category_display_name string")
    lines = [("p1", "o1", 1.0, 2.0), ("p1", "o1", 1.0, 2.0), ("p1", "o2", 3.0, 2.0), ("p1", None, 3.0, 2.0), (None, "o1", 1.0, 1.0)]
    items = frame(lines, "product_id string, order_id string, price double, freight_value double")
    row = dimensions.dim_products(products, categories, items).first()
    assert (row.total_orders, row.total_items_sold, row.total_revenue) == (2, 4, 8.0)


def test_a_day_s_sums_do_not_move_with_its_customers(shop, no_broadcast):
    plan = shop.plan("mart_executive_dashboard_fanout_safe")._jdf.queryExecution().executedPlan().toString()
    with_customer = [line for line in plan.splitlines() if "HashAggregate(keys=[date_key" in line and "customer_id" in line]
    assert with_customer and not any("sum(" in line for line in with_customer)


def test_reconciled_lines_stay_in_their_buckets(shop, no_broadcast):
    found = business._reconcile(shop["fct_order_items"], shop["dim_sellers"], "seller_id")
    assert set(moved(found)) == {"seller_id"}
