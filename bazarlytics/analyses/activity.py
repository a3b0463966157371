"""Retention answers from one small table: the months in which a customer bought, as bits.

A customer has one row per five years of activity with a bit per month, whatever the number of
their orders. Cohorts, churn and the spread of active months count equal bit patterns first, so
what is unpacked is bounded by the number of patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bazarlytics.functions.columns import ratio
from bazarlytics.operators.grouping import ordered

BITS = 60  # months of a row


def customer_activity(orders: DataFrame, customer_key: str = "customer_id") -> DataFrame:
    """customer_id, word, bits: bit b of word w stands for month 60 w + b of the calendar,
    counted from year 0. Only delivered orders with a customer and a month count."""
    month = (12 * F.year("order_month") + F.month("order_month") - 1).cast("long")
    return (
        orders.where(F.col("is_delivered") & F.col(customer_key).isNotNull() & F.col("order_month").isNotNull())
        .select(F.col(customer_key).alias("customer_id"), month.alias("n"))
        .groupBy("customer_id", F.expr(f"n div {BITS}").alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(n % {BITS} as int))")).alias("bits"))
    )


def merge(*tables: DataFrame) -> DataFrame:
    """Activity of several periods as one table; a month that stands in two of them counts once."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    return rows.groupBy("customer_id", "word").agg(F.bit_or("bits").alias("bits"))


def _months(patterns: DataFrame) -> DataFrame:
    """One row per set bit, as the month's number ``n``."""
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.getbit("bits", b) == 1)
    return patterns.withColumn("bit", F.explode(set_bits)).withColumn("n", F.col("word") * BITS + F.col("bit"))


def _date(n: Column) -> Column:
    return F.make_date((n / 12).cast("int"), (n % 12 + 1).cast("int"), F.lit(1))


def cohort_activity(activity: DataFrame) -> DataFrame:
    """Active customers by month of the first order and months since then."""
    bits = F.col("bits")
    lowest = F.bit_count(bits.bitwiseAND(-bits) - 1)
    first = F.min(F.col("word") * BITS + lowest).over(Window.partitionBy("customer_id"))
    patterns = activity.withColumn("first", first).groupBy("first", "word", "bits").agg(F.count("*").alias("k"))
    return (
        _months(patterns)
        .groupBy("first", "n")
        .agg(F.sum("k").alias("active_customers"))
        .select(
            _date(F.col("first")).alias("cohort_month"),
            (F.col("n") - F.col("first")).cast("int").alias("months_since_first"),
            "active_customers",
        )
        .transform(ordered, "cohort_month", "months_since_first")
    )


def monthly_churn(activity: DataFrame) -> DataFrame:
    """Customers of a month and of the active month before, and the relative fall."""
    patterns = activity.groupBy("word", "bits").agg(F.count("*").alias("k"))
    by_month = Window.orderBy("n")  # one row per month of the calendar
    now, before = F.col("active_customers"), F.col("prev_active_customers")
    return (
        _months(patterns)
        .groupBy("n")
        .agg(F.sum("k").alias("active_customers"))
        .withColumn("prev_active_customers", F.lag("active_customers").over(by_month))
        .where(before.isNotNull())
        .select(
            _date(F.col("n")).alias("month"),
            "active_customers",
            "prev_active_customers",
            ratio(before - now, before, 100).alias("churn_rate"),
            (-ratio(before - now, before, 100)).alias("net_active_change_pct"),
        )
        .transform(ordered, "month")
    )


def active_months(activity: DataFrame) -> DataFrame:
    """How many customers were active in how many months."""
    return (
        activity.groupBy("customer_id")
        .agg(F.sum(F.bit_count("bits")).alias("active_months"))
        .groupBy("active_months")
        .agg(F.count("*").alias("customers"))
        .transform(ordered, "active_months")
    )


def kept_between(activity: DataFrame) -> DataFrame:
    """Per month: its customers, and how many of them came back in the next month.

    A shift of the bits lays the next month over this one; across two rows of a customer the
    lowest bit of the next row stands in for it.
    """
    later = Window.partitionBy("customer_id").orderBy("word")
    follows = F.lead("word").over(later) == F.col("word") + 1
    carried = F.coalesce(F.when(follows, F.lead("bits").over(later).bitwiseAND(F.lit(1))), F.lit(0))
    shifted = F.shiftright("bits", 1).bitwiseOR(F.shiftleft(carried.cast("long"), BITS - 1))
    patterns = (
        activity.withColumn("again", F.col("bits").bitwiseAND(shifted))
        .groupBy("word", "bits", "again")
        .agg(F.count("*").alias("k"))
    )
    back = F.getbit("again", F.col("bit")) == 1
    return (
        _months(patterns)
        .groupBy("n")
        .agg(F.sum("k").alias("customers"), F.sum(F.when(back, F.col("k")).otherwise(0)).alias("came_back"))
        .select(
            _date(F.col("n")).alias("month"), "customers", "came_back",
            ratio(F.col("came_back"), F.col("customers"), 100).alias("came_back_pct"),
        )
        .transform(ordered, "month")
    )
