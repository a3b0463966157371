"""Grouped operators that stay balanced when one key holds a large share of the rows.

Each counts at (key, value) grain first. That step combines on the map side and spreads a
hot key over all its values, so only small per-value summaries meet at the key itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazarlytics.functions.columns import col


def dealt(df: DataFrame, keys: Sequence[str], *columns: str) -> DataFrame:
    """The named columns dealt by keys that hardly repeat, before an aggregation by them.

    There, rows as they are take less room in a shuffle than buffers that combined nothing.
    """
    return df.select(*keys, *columns).repartition(*keys)


_BUCKETS, MOST_ROWS = 16_384, 250_000


def has_hot_key(df: DataFrame, key: str, most_rows: int = MOST_ROWS) -> bool:
    """Whether a known key may have more rows than a task takes on average, and over ``most_rows``.

    Rows are counted in buckets of the key, and only the counts are shuffled.
    """
    counted = (
        df.filter(F.col(key).isNotNull())
        .groupBy(F.pmod(F.xxhash64(key), F.lit(_BUCKETS)))
        .agg(F.count("*").alias("_rows"))
        .agg(F.max("_rows").alias("most"), F.sum("_rows").alias("rows"))
        .first()
    )
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (counted["most"] or 0) > max(most_rows, (counted["rows"] or 0) / tasks)


def dealt_by(df: DataFrame, key: str, spread: str, hot: bool, *columns: str) -> DataFrame:
    """The named columns of all rows with a known key, dealt by it for the aggregations by it.

    Where a key has few rows in a task, a sum by (key, spread) and a further one by the key each
    move as many rows again. Rows dealt by the key alone move once, and nothing by the key or by
    it and other columns is shuffled after that. With a hot key they are dealt by (key, spread).
    """
    known = df.filter(F.col(key).isNotNull())
    return dealt(known, [key, spread] if hot else [key], *([] if hot else [spread]), *columns)


def most_frequent(value: Column | str, frequency: Column | str) -> Column:
    """Aggregate over per-value counts: the most frequent value, the smallest one on a tie."""
    value, frequency = col(value), col(frequency)
    best = F.min(F.when(value.isNotNull(), F.struct((-frequency).alias("_f"), value.alias("_v"))))
    return best.getField("_v")


def value_profile(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    distinct: str,
    mode: str,
    weight: Column | str | None = None,
) -> DataFrame:
    """Distinct non-NULL values per key and the most frequent one."""
    frequency = F.count("*") if weight is None else F.sum(col(weight))
    counted = df.groupBy(*keys, value).agg(frequency.alias("_freq"))
    return counted.groupBy(*keys).agg(
        F.count(value).alias(distinct), most_frequent(value, "_freq").alias(mode)
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by halves, so that a long list does not nest as deep as it is long."""
    if len(frames) == 1:
        return frames[0]
    middle = len(frames) // 2
    return union_all(frames[:middle]).unionByName(union_all(frames[middle:]))


def ordered(df: DataFrame, *order_by: Column | str) -> DataFrame:
    """A grouped result in order, for results bounded by a label list or the calendar.

    The few rows meet in one task. A global sort would first run the query once more to
    sample range bounds for them.
    """
    return df.repartition(1).sortWithinPartitions(*order_by)


def top(df: DataFrame, n: int, *order_by: Column | str) -> DataFrame:
    """First n rows of an order that must be unique; one bounded heap per task."""
    return df.orderBy(*order_by).limit(n)


def best_and_worst(
    df: DataFrame, n: int, best: Sequence[Column], worst: Sequence[Column]
) -> DataFrame:
    """The top n by one order followed by the top n by another; short inputs repeat rows."""
    return top(df, n, *best).withColumn("side", F.lit("best")).unionByName(
        top(df, n, *worst).withColumn("side", F.lit("worst"))
    )


def share_of_total(df: DataFrame, **shares: str) -> DataFrame:
    """Add percentage-of-total columns, ``new=existing``, to an already grouped frame.

    The frame holds one row per label of a fixed list, so its total is a window over it;
    a second aggregation would scan the source twice.
    """
    whole = Window.partitionBy(F.lit(0))
    return df.withColumns(
        {
            name: F.try_divide(
                F.col(value).cast("double"), F.sum(F.col(value).cast("double")).over(whole)
            )
            * 100.0
            for name, value in shares.items()
        }
    )
