"""An update of the order fact that rewrites only the months whose inputs changed.

Beside the table lies one checksum per month over every input row that reaches it: the orders,
their customers, reviews, payments and lines. A refresh computes the checksums anew, builds the
months whose checksums differ from the stored ones, and replaces just those partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazarlytics.operators.checksums import SEEDS, row_hash, within
from bazarlytics.operators.grouping import union_all
from bazarlytics.plans import facts as fct
from bazarlytics.plans import intermediate as inter
from bazarlytics.sources.files import write_table

MONTH = "order_month"
EMPTY_PARTITION = "__HIVE_DEFAULT_PARTITION__"  # the folder of a null month
CHECKSUMS = "order_month date, rows long, sum_1 decimal(38,0), sum_2 decimal(38,0)"


def month_checksums(orders: DataFrame, customers: DataFrame, details: Sequence[DataFrame]) -> DataFrame:
    """order_month, rows, sum_1 and sum_2 over the orders of a month and all that belongs to them.

    Every input row becomes (order, hashes), and one shuffle by order brings its month along,
    so no detail is joined. Details without an order reach no month. An order whose rows lie in
    several months counts its details in each of them.
    """
    who = customers.select("customer_id", *[row_hash(customers.columns, s).alias(f"c{s}") for s in SEEDS])
    own = [
        (row_hash(orders.columns, s).cast("decimal(20,0)") + F.coalesce(F.col(f"c{s}"), F.lit(0))).alias(f"h{s}")
        for s in SEEDS
    ]
    heads = orders.join(who, "customer_id", "left").select("order_id", F.struct(MONTH).alias("at"), *own)
    nowhere = F.lit(None).cast(heads.schema["at"].dataType)
    lines = [
        d.select(
            "order_id",
            nowhere.alias("at"),
            # the inputs have seeds of their own, or equal rows of two tables could be exchanged
            *[row_hash(d.columns, s + len(SEEDS) * i).cast("decimal(21,0)").alias(f"h{s}") for s in SEEDS],
        )
        for i, d in enumerate(details, 1)
    ]
    per_order = (
        union_all([heads, *lines])
        .groupBy("order_id")
        .agg(
            F.collect_set("at").alias("months"),  # bounded by the calendar
            F.count("*").alias("n"),
            *[F.sum(f"h{s}").alias(f"h{s}") for s in SEEDS],
        )
    )
    return (
        per_order.select(F.explode("months").alias("at"), "n", *[f"h{s}" for s in SEEDS])
        .groupBy(F.col(f"at.{MONTH}").alias(MONTH))
        .agg(F.sum("n").alias("rows"), *[F.sum(f"h{s}").cast("decimal(38,0)").alias(f"sum_{s}") for s in SEEDS])
    )


def stored_checksums(spark: SparkSession, path: str) -> dict:
    """The checksums of the last refresh by month; none where there was no whole one."""
    try:
        rows = spark.read.schema(CHECKSUMS).parquet(f"{path}_months").collect()  # one row per month
    except AnalysisException:
        return {}
    return {r[MONTH]: tuple(r)[1:] for r in rows}


def refresh_orders(
    path: str,
    orders: DataFrame,
    customers: DataFrame,
    reviews: DataFrame,
    payments: DataFrame,
    items: DataFrame,
    dedup_reviews: bool = False,
) -> list:
    """Bring the stored order fact at ``path`` up to date and return the months that were rewritten.

    The inputs are staged tables. The result equals a full build. Without stored checksums
    everything is built. A month that lost all its orders becomes an empty partition. Data is
    written before the checksums, so a refresh that broke off is repeated by the next one; a
    reader meanwhile may see some months new and others old.
    """
    spark = orders.sparkSession
    found = month_checksums(orders, customers, [reviews, payments, items]).collect()  # one row per month
    new, old = {r[MONTH]: tuple(r)[1:] for r in found}, stored_checksums(spark, path)
    changed = [m for m, sums in new.items() if old.get(m) != sums]
    gone = [m for m in old if m not in new]

    def model(*inputs: DataFrame) -> DataFrame:
        orders, reviews, payments, items = inputs
        enriched = inter.int_orders_enriched(orders, customers, reviews, dedup_reviews)
        return fct.fct_orders(enriched, inter.int_order_payments_aggregated(payments), items)

    if not old:
        write_table(model(orders, reviews, payments, items), path, MONTH)
    elif changed:
        some = orders.where(within(MONTH, changed))
        ids = some.select("order_id").distinct()
        part = model(some, *(d.join(ids, "order_id", "left_semi") for d in (reviews, payments, items)))
        writer = part.hint("rebalance", MONTH).write.mode("overwrite").partitionBy(MONTH)
        writer.option("partitionOverwriteMode", "dynamic").parquet(path)
    for month in gone:
        nothing = model(orders, reviews, payments, items).drop(MONTH).where(F.lit(False))
        nothing.write.mode("overwrite").parquet(f"{path}/{MONTH}={month or EMPTY_PARTITION}")
    if changed or gone or not old:
        rows = [(month, *sums) for month, sums in new.items()]
        write_table(spark.createDataFrame(rows, CHECKSUMS).coalesce(1), f"{path}_months")
    return sorted([*changed, *gone], key=lambda m: (m is not None, m))


def read_orders(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The stored fact with the columns of a model in their order."""
    return spark.read.schema(like.schema).parquet(path).select(like.columns)
