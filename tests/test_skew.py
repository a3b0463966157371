"""One key with a third of all rows: same results as a plain computation, and split joins."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bazarlytics.plans import dimensions, intermediate
from bazarlytics.plans.warehouse import Warehouse
from bazarlytics.sources.schemas import RAW

ORDERS = 6000


def hot(key, share, prefix):
    """The key 'hot' on one row in ``share``, spread keys elsewhere."""
    return F.when(F.col("id") % share == 0, F.lit(f"{prefix}hot")).otherwise(
        F.concat(F.lit(prefix), F.col("id") % key)
    )


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    start = F.lit(dt.datetime(2017, 1, 1))
    ids = spark.range(ORDERS)
    bought = (start + F.make_dt_interval(F.col("id").cast("int") % 400)).cast("timestamp_ntz")
    place = F.lit("01000").alias("zip"), F.lit("city"), F.lit("SP")

    def typed(table, df):
        schema = RAW[table]
        return df.select(*[c.cast(f.dataType).alias(f.name) for c, f in zip([F.col(x) for x in df.columns], schema)])

    orders = ids.select(
        F.concat(F.lit("o"), "id"), hot(500, 3, "c"), F.lit("delivered"), bought, bought,
        bought, bought + F.expr("interval 5 days"), bought + F.expr("interval 9 days"),
    )
    items = spark.range(ORDERS * 3).select(
        F.concat(F.lit("o"), (F.col("id") / 3).cast("int")), F.col("id") % 3 + 1, hot(200, 3, "p"), hot(50, 3, "s"),
        F.lit(None), (F.col("id") % 90 + 10), F.lit(3),
    )
    payments = ids.select(F.concat(F.lit("o"), "id"), F.lit(1), F.lit("boleto"), F.lit(1), F.lit(20))
    # a third of all reviews belongs to one order
    reviews = ids.select(
        F.concat(F.lit("r"), "id"), F.when(F.col("id") % 3 == 0, "o7").otherwise(F.concat(F.lit("o"), "id")),
        F.col("id") % 5 + 1, F.lit(None), F.lit(None), start, F.lit(None),
    )

    def names(kind, count):
        return spark.range(count + 1).select(
            F.when(F.col("id") == count, f"{kind}hot").otherwise(F.concat(F.lit(kind), "id")).alias("key")
        )

    frames = {
        "orders": orders, "order_items": items, "payments": payments, "reviews": reviews,
        "customers": names("c", 500).select("key", "key", *place),
        "sellers": names("s", 50).select("key", *place),
        "products": names("p", 200).select("key", F.lit("cat_a"), *[F.lit(None).alias(str(i)) for i in range(7)]),
        "category_translation": spark.range(1).select(F.lit("cat_a"), F.lit("toys")),
        "geolocation": spark.range(1).select(F.lit("01000"), F.lit(-20), F.lit(-40), F.lit("city"), F.lit("SP")),
    }
    raw = {t: (lambda t=t: typed(t, frames[t].toDF(*RAW[t].names))) for t in RAW}
    return Warehouse(spark, raw, str(tmp_path_factory.mktemp("skewed")))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_hot_customer(skewed):
    direct = skewed["fct_orders"].groupBy("customer_id").agg(
        F.countDistinct("order_id").alias("n"), F.sum("total_order_value").alias("v"), F.round(F.avg("review_score"), 6).alias("s")
    )
    mart = skewed["mart_customer_analytics"].filter("total_orders > 0")
    assert rows(mart, "customer_id", "total_orders", "lifetime_value", F.round("avg_review_score", 6)) == rows(direct, "customer_id", "n", "v", "s")
    assert mart.filter("customer_id = 'chot'").first().total_orders == ORDERS // 3


def test_hot_seller_and_product(skewed):
    joined = skewed["fct_order_items"].join(skewed["fct_reviews"].select("order_id", "review_id", "review_score"), "order_id")
    for key, mart in (("seller_id", "mart_seller_scorecard"), ("product_id", "mart_product_performance")):
        direct = joined.groupBy(key).agg(F.countDistinct("review_id").alias("n"), F.round(F.avg("review_score"), 6).alias("s"))
        ours = skewed[mart].filter("total_reviews > 0")
        assert rows(ours, key, "total_reviews", F.round("avg_review_score", 6)) == rows(direct, key, "n", "s")


def test_hot_order_fans_out_in_full(skewed):
    # the order with a third of the reviews keeps every one of them
    extra = ORDERS // 3
    assert skewed["fct_orders"].filter("order_id = 'o7'").count() == extra + 1
    day = skewed["mart_executive_dashboard"].filter("total_reviews > 1000").first()
    fan = skewed["fct_orders"].filter(F.col("order_date") == day.date_day).join(
        skewed["fct_order_items"].select("order_id", "seller_id"), "order_id"
    ).join(skewed["fct_reviews"].select("order_id", F.col("review_score").alias("score")), "order_id", "left")
    direct = fan.agg(F.sum("total_order_value").alias("v"), F.avg("score").alias("s")).first()
    assert day.total_revenue == pytest.approx(float(direct.v)) and day.avg_review_score == pytest.approx(direct.s)


def test_join_on_a_hot_key_is_split(spark, skewed):
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        # many scan tasks, so that the hot partition consists of several blocks
        items = skewed["stg_order_items"].repartition(16)
        enriched = intermediate.int_order_items_enriched(
            items, skewed["stg_products"], skewed["stg_sellers"], skewed["stg_category_translation"]
        )
        plan = enriched.select("order_id", "product_volume_cm3", "seller_city")
        plan.collect()
        assert "skew=true" in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_distinct_counts_spread_a_hot_key(skewed):
    # the exchange before the last one is keyed by (seller, order), never by the seller alone
    plan = dimensions.dim_sellers(
        skewed["stg_sellers"], skewed["stg_order_items"], skewed["stg_orders"], skewed["stg_reviews"]
    )._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Expand" not in plan and "CartesianProduct" not in plan


def test_no_python_in_the_models(skewed):
    for name in ("fct_orders", "mart_customer_analytics", "mart_executive_dashboard", "mart_seller_scorecard"):
        plan = skewed.plan(name)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
