"""The nine raw tables derived from a general retail star schema.

Reads ``orders lineitem customer supplier part nation`` as Parquet and reshapes them, by
integer arithmetic on keys, into marketplace tables. Every order, line, customer, supplier
and part appears. Suppliers also appear as customers who never ordered, and nations as
sellers and products without sales, so that the empty branches of the models have data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazarlytics.functions.columns import case, lookup
from bazarlytics.operators.ordering import number_rows_within
from bazarlytics.sources.schemas import RAW

# --- fixed values: nation key 0..24 to state code, category names in English ----------
NATION_STATES = [
    "AC", "AL", "AP", "AM", "BA", "CE", "DF", "ES", "GO", "MA", "MT", "MS", "MG",
    "PA", "PB", "PR", "PE", "PI", "RJ", "RN", "RS", "RO", "SC", "SP", "SE",
]
# category 11 has no translation and category 99 has no products, on purpose
CATEGORY_ENGLISH = {
    0: "health_beauty", 1: "furniture_decor", 2: "computers_accessories", 3: "toys",
    4: "watches_gifts", 5: "auto", 6: "books_technical", 7: "cool_stuff", 8: "pet_shop",
    9: "stationery", 10: "bed_bath_table", 99: "flowers",
}
# lines of an order that agree in these give the same rows, whichever comes first
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]


def _state(nation: str):
    return F.element_at(F.array(*[F.lit(s) for s in NATION_STATES]), F.col(nation).cast("int") + 1)


def _id(prefix: str, key: str):
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def _cents(amount):
    return (amount * F.expr("0.01BD")).cast("decimal(10,2)")


def _later(moment: str, amount: str, unit: str):
    """A moment moved by a whole number of days, hours or seconds."""
    places = {"days": "{0}", "hours": "0, {0}", "seconds": "0, 0, 0, {0}"}
    return F.expr(f"{moment} + make_dt_interval({places[unit].format(f'cast({amount} as int)')})")


def _place(df: DataFrame, nation: str, key: str, zips: int) -> DataFrame:
    return df.withColumns(
        {
            "zip": (F.lit(10000) + F.col(nation) * 100 + F.col(key) % zips).cast("string"),
            "city": F.concat(
                F.lit("city_"), F.col(nation).cast("string"), F.lit("_"),
                (F.col(key) % 5).cast("string"),
            ),
            "state": _state(nation),
        }
    )


def _base_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    return orders.select(
        F.col("o_orderkey").alias("k"),
        "o_custkey",
        "o_orderpriority",
        _later("o_orderdate", "o_orderkey * 37 % 86400", "seconds").alias("bought"),
        _later("o_orderdate", "20 + o_orderkey % 10", "days").alias("due"),
        lookup(
            F.col("o_orderkey") % 20,
            {0: "canceled", 1: "shipped", 2: "unavailable", 3: "processing"},
            "delivered",
        ).alias("status"),
    )


def orders(spark: SparkSession, folder: str) -> DataFrame:
    b = _base_orders(spark, folder)
    arrived = F.when(
        (F.col("status") == "delivered") & (F.col("k") % 211 != 0),
        F.when(F.col("k") % 101 == 0, F.col("due")).otherwise(
            _later("bought", "3 + k % 37", "days")
        ),
    )
    return b.select(
        _id("o", "k").alias("order_id"),
        _id("c", "o_custkey").alias("customer_id"),
        F.col("status").alias("order_status"),
        F.col("bought").alias("order_purchase_timestamp"),
        F.when(F.col("k") % 97 != 0, _later("bought", "k % 48", "hours")).alias(
            "order_approved_at"
        ),
        F.when(
            F.col("status").isin("delivered", "shipped"),
            _later("bought", "1 + k % 5", "days"),
        ).alias("order_delivered_carrier_date"),
        arrived.alias("order_delivered_customer_date"),
        F.col("due").alias("order_estimated_delivery_date"),
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    buyers = spark.read.parquet(f"{folder}/customer.parquet").select(
        _id("c", "c_custkey").alias("customer_id"),
        F.concat(F.lit("u"), F.col("c_custkey") - F.col("c_custkey") % 3).alias("person"),
        F.col("c_custkey").alias("key"),
        F.col("c_nationkey").alias("nation"),
    )
    idle = spark.read.parquet(f"{folder}/supplier.parquet").select(
        _id("cs", "s_suppkey").alias("customer_id"),
        _id("us", "s_suppkey").alias("person"),
        F.col("s_suppkey").alias("key"),
        F.col("s_nationkey").alias("nation"),
    )
    return _place(buyers.unionByName(idle), "nation", "key", 20).select(
        "customer_id",
        F.col("person").alias("customer_unique_id"),
        F.col("zip").alias("customer_zip_code_prefix"),
        F.col("city").alias("customer_city"),
        F.col("state").alias("customer_state"),
    )


def sellers(spark: SparkSession, folder: str) -> DataFrame:
    active = spark.read.parquet(f"{folder}/supplier.parquet").select(
        _id("s", "s_suppkey").alias("seller_id"),
        F.col("s_suppkey").alias("key"),
        F.col("s_nationkey").alias("nation"),
    )
    idle = spark.read.parquet(f"{folder}/nation.parquet").select(
        _id("sn", "n_nationkey").alias("seller_id"),
        F.col("n_nationkey").cast("long").alias("key"),
        F.col("n_nationkey").alias("nation"),
    )
    return _place(active.unionByName(idle), "nation", "key", 30).select(
        "seller_id",
        F.col("zip").alias("seller_zip_code_prefix"),
        F.col("city").alias("seller_city"),
        F.col("state").alias("seller_state"),
    )


def order_items(spark: SparkSession, folder: str) -> DataFrame:
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        _id("o", "l_orderkey").alias("order_id"), *LINE_ORDER
    )
    # by the order as the tables name it, so that what follows needs no other exchange
    numbered = number_rows_within(lines, ["order_id"], LINE_ORDER, "order_item_id")
    bought = _base_orders(spark, folder).select(_id("o", "k").alias("order_id"), "bought")
    k = F.expr("substring(order_id, 2)").cast("long")
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    return numbered.join(bought, "order_id", "left").select(
        "order_id",
        "order_item_id",
        _id("p", "l_partkey").alias("product_id"),
        _id("s", "l_suppkey").alias("seller_id"),
        _later("bought", "5", "days").alias("shipping_limit_date"),
        _cents(F.lit(500) + (part * 7919 + k * 31) % 45000).alias("price"),
        _cents(F.lit(300) + (k * 17 + supp * 13) % 5000).alias("freight_value"),
    )


def payments(spark: SparkSession, folder: str) -> DataFrame:
    b = _base_orders(spark, folder)
    k = F.col("k")
    kind = lookup(
        F.substring("o_orderpriority", 1, 1),
        {"1": "credit_card", "3": "credit_card", "2": "boleto", "4": "debit_card"},
        "voucher",
    )
    # none, one or two payments per order
    count = case([(k % 333 == 0, 0), (k % 10 == 0, 2)], 1)
    each = b.withColumn("kind", kind).withColumn(
        "n", F.explode(F.filter(F.array(F.lit(1), F.lit(2)), lambda i: i <= count))
    )
    first = F.col("n") == 1
    return each.select(
        _id("o", "k").alias("order_id"),
        F.col("n").alias("payment_sequential"),
        F.when(first, F.col("kind")).otherwise("voucher").alias("payment_type"),
        F.when(first & (F.col("kind") == "credit_card"), k % 15)
        .otherwise(1)
        .cast("int")
        .alias("payment_installments"),
        F.when(first, _cents(F.lit(1000) + k * 53 % 80000))
        .otherwise(_cents(F.lit(500) + k % 3000))
        .alias("payment_value"),
    )


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    b = _base_orders(spark, folder)
    k = F.col("k")
    # none, one or two reviews per order
    count = case([(k % 25 == 0, 0), (k % 180 == 1, 2)], 1)
    each = b.withColumn(
        "n", F.explode(F.filter(F.array(F.lit(1), F.lit(2)), lambda i: i <= count))
    ).withColumn("created", _later("due", "k % 45 - 15 + n", "days"))
    first = F.col("n") == 1
    return each.select(
        F.concat(F.lit("r"), k, F.lit("_"), F.col("n")).alias("review_id"),
        _id("o", "k").alias("order_id"),
        F.when(first, 1 + (k * 7 + k % 3) % 5).otherwise(1 + k % 5).cast("int").alias("review_score"),
        F.when(first & (k % 4 == 0), F.concat(F.lit("title "), k)).alias("review_comment_title"),
        F.when(first & (k % 3 != 0), F.repeat(F.lit("x"), (1 + k % 300).cast("int"))).alias(
            "review_comment_message"
        ),
        F.col("created").alias("review_creation_date"),
        F.when(first & (k % 50 != 7), _later("created", "k % 40", "days")).alias(
            "review_answer_timestamp"
        ),
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    parts = spark.read.parquet(f"{folder}/part.parquet").select(
        _id("p", "p_partkey").alias("product_id"),
        F.col("p_partkey").alias("key"),
        F.col("p_name").alias("name"),
        F.col("p_size").alias("size"),
    )
    unsold = spark.read.parquet(f"{folder}/nation.parquet").select(
        _id("pn", "n_nationkey").alias("product_id"),
        F.col("n_nationkey").cast("long").alias("key"),
        F.col("n_name").alias("name"),
        F.col("n_regionkey").alias("size"),
    )
    key, size = F.col("key"), F.col("size")
    both = parts.unionByName(unsold)
    return both.select(
        "product_id",
        F.when(key % 60 != 0, F.concat(F.lit("cat_"), key % 12)).alias("product_category_name"),
        F.when(key % 17 != 0, F.length("name")).alias("product_name_lenght"),
        (100 + key % 900).cast("int").alias("product_description_lenght"),
        (key % 7).cast("int").alias("product_photos_qty"),
        F.when(key % 61 != 0, size * 150).cast("decimal(10,2)").alias("product_weight_g"),
        (10 + size * 2).cast("decimal(10,2)").alias("product_length_cm"),
        (2 + key % 40).cast("decimal(10,2)").alias("product_height_cm"),
        (10 + key % 60).cast("decimal(10,2)").alias("product_width_cm"),
    )


def category_translation(spark: SparkSession, folder: str) -> DataFrame:
    """The translated categories among those of the parts, at most a dozen rows, and 99."""
    number = (F.col("p_partkey") % 12).cast("int")
    seen = spark.read.parquet(f"{folder}/part.parquet").select(F.explode(F.array(number, F.lit(99))).alias("n")).distinct()
    english = F.create_map(*[F.lit(x) for pair in CATEGORY_ENGLISH.items() for x in pair])
    return seen.select(
        F.concat(F.lit("cat_"), "n").alias("product_category_name"),
        F.try_element_at(english, F.col("n")).alias("product_category_name_english"),
    ).where(F.col("product_category_name_english").isNotNull())


def geolocation(spark: SparkSession, folder: str) -> DataFrame:
    zips = (
        customers(spark, folder)
        .groupBy(F.col("customer_zip_code_prefix").alias("zip"))
        .agg(F.min("customer_city").alias("city"), F.min("customer_state").alias("state"))
    )
    step = F.col("zip").cast("int") - 10000
    shift = F.col("d") * F.expr("0.001BD")
    return zips.withColumn("d", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        F.col("zip").alias("geolocation_zip_code_prefix"),
        (F.lit(-30) + step * F.expr("0.01BD") + shift)
        .cast("decimal(10,6)")
        .alias("geolocation_lat"),
        (F.lit(-60) + step * F.expr("0.005BD") + shift)
        .cast("decimal(10,6)")
        .alias("geolocation_lng"),
        F.col("city").alias("geolocation_city"),
        F.col("state").alias("geolocation_state"),
    )


TABLES = {
    "orders": orders,
    "customers": customers,
    "order_items": order_items,
    "payments": payments,
    "reviews": reviews,
    "products": products,
    "sellers": sellers,
    "geolocation": geolocation,
    "category_translation": category_translation,
}


# --- run history derived from the event stream ----------------------------------------
# fixed values: model names an event may stand for
EVENT_MODELS = [
    "stg_orders", "stg_reviews", "int_orders_enriched", "dim_customers", "dim_date",
    "fct_orders", "fct_payments", "mart_executive_dashboard", "seed_rates",
]


def model_history(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as one model execution in its user's run of that day."""
    event = F.col("event_id")
    name = F.element_at(
        F.array(*[F.lit(m) for m in EVENT_MODELS]),
        (event % len(EVENT_MODELS)).cast("int") + 1,
    )
    events = spark.read.parquet(f"{folder}/events.parquet").withColumn("model", name)
    return events.select(
        F.concat(F.lit("run_"), "user_id", F.date_format("ts", "_yyyyMMdd")).alias("invocation_id"),
        F.col("model").alias("model_name"),
        F.lit("core").alias("schema_name"),
        case(
            [
                (F.col("model").startswith("stg_"), "view"),
                (F.col("model").startswith("int_"), "ephemeral"),
            ],
            "table",
        ).alias("materialization"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        F.col("value").alias("execution_time_seconds"),
        (event % 1000).cast("int").alias("rows_affected"),
        F.col("ts").alias("executed_at"),
        F.concat(F.lit("model.shop."), "model", F.lit("."), event).alias("unique_id"),
    )


def run_history(spark: SparkSession, folder: str) -> DataFrame:
    """The runs of ``model_history``, their command derived from the user."""
    runs = (
        model_history(spark, folder)
        .groupBy("invocation_id")
        .agg(
            F.min("executed_at").alias("run_started_at"),
            F.max("executed_at").alias("run_completed_at"),
            F.bool_and(F.col("status") == "success").alias("success"),
            F.count("*").cast("int").alias("total_models"),
            F.sum(F.when(F.col("rows_affected") < 100, 1).otherwise(0)).cast("int").alias("total_tests"),
            F.sum("execution_time_seconds").alias("total_runtime_seconds"),
        )
    )
    user = F.split("invocation_id", "_")[1].cast("long")
    return runs.withColumns(
        {
            "dbt_command": lookup(user % 3, {0: "build", 1: "run"}, "test"),
            "dbt_version": F.lit("1.0"),
            "target_name": F.lit("prod"),
        }
    )
