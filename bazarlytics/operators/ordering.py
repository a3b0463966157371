"""Global order statistics without a single-partition window.

A sort on a unique key range-partitions the rows evenly however often a value repeats,
and ``monotonically_increasing_id`` then encodes (partition, place within it). Adding the
sizes of the partitions before gives every row its global number. The sorted rows are
frozen first, so a lost executor cannot change the numbering between its two uses. The
table of offsets has one row per shuffle partition, which bounds what is broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazarlytics.session import freeze

_PART, _PLACE = "_part", "_place"
_BUCKETS = 65_536


def number_rows(df: DataFrame, order_by: Sequence[Column | str], name: str = "row_num") -> DataFrame:
    """Number all rows 1..N in the given order (make it unique for a repeatable result)."""
    placed = df.sort(*order_by).withColumn(_PLACE, F.monotonically_increasing_id())
    frozen = freeze(placed).withColumn(_PART, F.shiftright(_PLACE, 33))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        frozen.groupBy(_PART)
        .agg(F.count("*").alias("_rows"))
        .select(_PART, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    place = F.col(_PLACE).bitwiseAND(F.lit((1 << 33) - 1))
    return (
        frozen.join(F.broadcast(offsets), _PART)
        .withColumn(name, F.col("_before") + place + 1)
        .drop(_PART, _PLACE, "_before")
    )


def running_total(
    df: DataFrame, order_by: Sequence[Column | str], amount: str, name: str
) -> DataFrame:
    """Add the sum of an amount over all rows up to this one, in an order without ties.

    Each sorted partition is summed by itself and raised by the sum of those before it.
    """
    frozen = freeze(df.sort(*order_by).withColumn(_PART, F.spark_partition_id()))
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        frozen.groupBy(_PART)
        .agg(F.sum(amount).alias("_sum"))
        .select(_PART, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(_PART).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    return (
        frozen.join(F.broadcast(offsets), _PART)
        .withColumn(name, F.col("_before") + F.sum(amount).over(inside))
        .drop(_PART, "_before")
    )


def number_rows_within(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[Column | str],
    name: str,
    most_rows: int = 250_000,
) -> DataFrame:
    """Number the rows of every known key 1..n.

    The rows are counted in ``_BUCKETS`` buckets of their keys first, of which little is shuffled.
    Keys of buckets with at most ``most_rows`` rows are numbered by a window, on one exchange that
    a join by the same keys shares. Only the keys of larger buckets are numbered by a sort over
    many tasks, since such a key may be too large for one.
    """
    known = df.dropna(subset=list(keys))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(_BUCKETS))
    counted = known.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_rows"))
    large = [r["_bucket"] for r in counted.filter(F.col("_rows") > most_rows).collect()]
    inside = Window.partitionBy(*keys).orderBy(*order_by)

    def by_window(rows: DataFrame) -> DataFrame:
        return rows.withColumn(name, F.row_number().over(inside))

    if not large:
        return by_window(known)
    return by_window(known.filter(~bucket.isin(large))).unionByName(
        _number_large_keys(known.filter(bucket.isin(large)), keys, order_by, name)
    )


def _number_large_keys(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[Column | str], name: str
) -> DataFrame:
    """number_rows_within() for keys whose rows spread over many tasks."""
    numbered = number_rows(df, [*keys, *order_by], "_n")
    firsts = numbered.groupBy(*keys).agg(F.min("_n").alias("_first"))
    return (
        numbered.join(firsts, list(keys))
        .withColumn(name, (F.col("_n") - F.col("_first") + 1).cast("int"))
        .drop("_n", "_first")
    )


def _exact(value: Column | str) -> Column:
    """Counts and money in one exact type, so that several measures share a sort."""
    return (F.col(value) if isinstance(value, str) else value).cast("decimal(38,6)")


def bucket_bounds(df: DataFrame, specs: Mapping[str, str], tie: str, buckets: int) -> DataFrame:
    """One row: for each measure the last (value, tie) pair of every bucket but the final one.

    All measures are numbered in one sort by (measure, value, tie). With N = q * buckets + m
    known values, bucket i of a measure ends at its row i * q + min(i, m). At most
    ``buckets - 1`` pairs per measure come back, so any frame can be bucketed against them
    without being sorted or joined itself.
    """
    measures = F.array(
        *[F.struct(F.lit(name).alias("_m"), _exact(v).alias("_v")) for name, v in specs.items()]
    )
    known = df.select(F.col(tie).alias("_t"), F.inline(measures)).filter("_v IS NOT NULL")
    numbered = number_rows(known, ["_m", "_v", "_t"], "_n")
    i, total = F.col("_i"), F.col("_total")
    ends = (
        numbered.groupBy("_m")
        .agg(F.min("_n").alias("_first"), F.count("*").alias("_total"))
        .withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(buckets - 1))))
        .select(
            (F.col("_first") - 1 + i * F.floor(total / buckets) + F.least(i, total % buckets)).alias(
                "_n"
            )
        )
    )
    pairs = (
        numbered.join(F.broadcast(ends), "_n")
        .groupBy("_m")
        .agg(F.collect_list(F.struct("_v", "_t")).alias("_pairs"))
    )
    return pairs.agg(F.map_from_entries(F.collect_list(F.struct("_m", "_pairs"))).alias("bounds"))


def with_ntiles(
    df: DataFrame, specs: Mapping[str, str], tie: str, buckets: int = 5
) -> DataFrame:
    """Add ntile columns, ``{new column: value column}``; rows with a NULL value get NULL."""
    out = df.withColumn("_bounds", bucket_bounds(df, specs, tie, buckets).scalar())
    for name, value in specs.items():
        here = F.struct(_exact(value).alias("_v"), F.col(tie).alias("_t"))
        passed = F.size(F.filter(F.col("_bounds")[name], lambda b: b < here))
        out = out.withColumn(name, F.when(F.col(value).isNotNull(), passed + 1))
    return out.drop("_bounds")


def _cumulative_counts(df: DataFrame, value: Column) -> DataFrame:
    """Distinct values with their count ``_n`` and the rows ``_upto`` that do not exceed them.

    Equal values are counted before the sort, so a value that holds most rows is one row.
    """
    counted = df.groupBy(value.alias("_v")).agg(F.count("*").alias("_n"))
    return running_total(counted, [F.col("_v").asc_nulls_last()], "_n", "_upto")


def with_percent_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add (rank - 1) / (N - 1) over the whole frame, ties sharing the lowest rank."""
    ranks = _cumulative_counts(df, F.col(value))
    total = ranks.agg(F.sum("_n")).scalar()
    below = F.col("_upto") - F.col("_n")
    return (
        df.join(ranks, F.col(value).eqNullSafe(F.col("_v")), "left")
        .withColumn("_total", total)
        .withColumn(name, F.when(F.col("_total") > 1, below / (F.col("_total") - 1)).otherwise(0.0))
        .drop("_v", "_n", "_upto", "_total")
    )


def exact_median(df: DataFrame, value: str, name: str = "median") -> DataFrame:
    """One row: the middle value, or the mean of the two middle values."""
    known = df.filter(F.col(value).isNotNull())
    ranks = _cumulative_counts(known, F.col(value).cast("double"))
    total, upto = F.col("_total"), F.col("_upto")
    # the rows numbered floor((N + 1) / 2) and ceil((N + 1) / 2), which may be the same
    middles = F.array(F.floor((total + 1) / 2), F.ceil((total + 1) / 2))
    hits = F.size(F.filter(middles, lambda m: (m <= upto) & (m > upto - F.col("_n"))))
    return (
        ranks.withColumn("_total", ranks.agg(F.sum("_n")).scalar())
        .withColumn("_hits", hits)
        .agg((F.sum(F.col("_v") * F.col("_hits")) / F.sum("_hits")).alias(name))
    )
