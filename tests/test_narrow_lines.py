"""Lines move through few and narrow shuffles, and keys are numbered alike either way."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from bazarlytics.operators.ordering import number_rows_within
from bazarlytics.plans import dimensions, facts, intermediate
from bazarlytics.quality import business
from bazarlytics.sources import retail


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(str, df.collect()))


def test_large_and_small_keys_are_numbered_alike(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 100 != 1, F.col("id") % 50).alias("k"),
        (F.col("id") * 7919 % 3001).alias("v"),
    )
    known = df.where("k is not null")
    expected = known.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("v")))
    for most in (10, 500, 10_000):
        assert rows(number_rows_within(df, ["k"], ["v"], "n", most_rows=most)) == rows(expected)


def test_lines_are_numbered_in_one_shuffle_of_their_keys(spark, tmp_path):
    orders = spark.sql("select id as o_orderkey, id as o_custkey, '1-URGENT' as o_orderpriority, timestamp_ntz'1996-01-01' as o_orderdate from range(9)")
    lines = spark.sql(
        "select id % 10 as l_orderkey, id % 4 as l_partkey, id % 3 as l_suppkey, cast(id % 2 as int) as l_linenumber, "
        "1.0d as l_quantity, 'N' as l_returnflag from range(60)"
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    lines.unionByName(lines.withColumn("l_orderkey", F.lit(None).cast("long"))).write.parquet(f"{tmp_path}/lineitem.parquet")
    items = retail.order_items(spark, str(tmp_path))
    plan = plan_of(items)
    assert "l_quantity" not in plan and "rangepartitioning" not in plan
    found = items.groupBy("order_id").agg(F.sort_array(F.collect_list("order_item_id")).alias("n")).collect()
    assert len(found) == 10 and all(r.n == list(range(1, 7)) for r in found)


def test_order_grain_moves_rows_not_buffers(spark):
    items = spark.sql(
        "select concat('o', id % 40) as order_id, concat('s', id % 3) as seller_id, concat('p', id % 7) as product_id, "
        "cast(id as decimal(10,2)) as price, cast(1 as decimal(10,2)) as freight_value from range(200)"
    )
    baskets = dimensions.seller_baskets(items)
    plan = plan_of(baskets)
    plain = items.groupBy("seller_id", "order_id").agg(
        F.count("*").alias("lines"), F.sum("price").alias("revenue"), F.count("price").alias("priced"),
        F.sum("freight_value").alias("freight"), F.count("freight_value").alias("freighted"),
    )
    assert rows(baskets) == rows(plain)
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_COL" in plan


def enriched_inputs(spark):
    items = spark.sql(
        "select concat('o', id % 5) as order_id, cast(id as int) as order_item_id, if(id % 4 = 0, null, concat('p', id % 3)) as product_id, "
        "concat('s', id % 2) as seller_id, timestamp_ntz'1996-01-05' as shipping_limit_date, cast(id + 1 as decimal(10,2)) as price, "
        "if(id = 3, null, cast(2 as decimal(10,2))) as freight_value from range(20)"
    ).withColumn("total_item_value", F.col("price") + F.col("freight_value"))
    sides = {f"product_{s}_cm": F.when(F.col("id") != 1, F.col("id") + 1.5).cast("decimal(10,2)") for s in ("length", "height", "width")}
    products = (
        spark.range(2).withColumns({"product_id": F.concat(F.lit("p"), "id"), "product_category_name": F.concat(F.lit("c"), "id"),
                                    "product_weight_g": F.lit(1).cast("decimal(10,2)"), **sides})
        .withColumn("product_volume_cm3", F.col("product_length_cm") * F.col("product_height_cm") * F.col("product_width_cm")).drop("id")
    )
    sellers = spark.sql("select 's0' as seller_id, 'z' as seller_zip_code_prefix, 'city' as seller_city, 'SP' as seller_state, 'SP' as seller_state_clean")
    categories = spark.sql("select 'c0' as product_category_name, 'toys' as product_category_name_english, 'toys' as category_display_name")
    context = spark.sql(
        "select concat('o', id) as order_id, 'c' as customer_id, 'delivered' as order_status, timestamp_ntz'1996-01-01' as order_purchase_timestamp, "
        "timestamp_ntz'1996-01-09' as order_delivered_customer_date, timestamp_ntz'1996-01-10' as order_estimated_delivery_date, "
        "'z' as customer_zip_code_prefix, 'city' as customer_city, 'SP' as customer_state from range(4)"
    )
    return items, products, sellers, categories, context


def test_lines_in_context_are_the_same_rows(spark):
    *tables, context = enriched_inputs(spark)
    plain = facts.fct_order_items(intermediate.int_order_items_enriched(*tables), context)
    narrow = facts.fct_order_items(intermediate.lines_in_context(*tables, context))
    assert [(f.name, f.dataType) for f in narrow.schema] == [(f.name, f.dataType) for f in plain.schema]
    assert rows(narrow) == rows(plain)


def test_orders_meet_on_one_exchange_by_order(spark):
    payments = spark.sql(
        "select concat('o', id % 9) as order_id, if(id % 2 = 0, 'voucher', 'boleto') as payment_type, "
        "cast(id as decimal(10,2)) as payment_value, cast(id % 3 as int) as payment_installments from range(60)"
    )
    paid = intermediate.int_order_payments_aggregated(payments)
    assert plan_of(paid).count("Exchange") == 1
    assert all(r.payment_method_count in (6, 7) and r.unique_payment_types == 2 for r in paid.collect())


def test_reconciling_moves_rows_not_buffers(spark):
    facts_ = spark.sql("select concat('s', id % 3) as seller_id, concat('o', id % 7) as order_id, cast(id as decimal(10,2)) as item_price from range(42)")
    told = spark.sql("select concat('s', id) as seller_id, 7L as total_orders, if(id = 1, 13L, 14L) as total_items_sold, cast(273 + 14 * id as decimal(20,2)) as total_revenue from range(3)")
    found = business._reconcile(facts_, told, "seller_id")
    assert "REPARTITION_BY_COL" in plan_of(found)
    assert [(r.seller_id, r.issue_type) for r in found.collect()] == [("s1", "Items mismatch")]
