"""Checksums of parts of a table, and the keys that differ between two tables.

A part is a value of one column with few values, such as a month. Two tables are first compared
by their parts' checksums, so rows move only for parts that differ.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# every row enters two sums of independent 64-bit hashes
SEEDS = (1, 2)


def row_hash(columns: Sequence[str], seed: int = 1) -> Column:
    """A row as a 64-bit number. Spark's hash passes over nulls, so their places are hashed too."""
    cells = [F.col(f"`{c}`") for c in columns]
    return F.xxhash64(F.lit(seed), *cells, *[c.isNull() for c in cells])


def hash_sum(value: Column) -> Column:
    """An exact sum of 64-bit numbers, in whatever order they come."""
    return F.sum(value.cast("decimal(20,0)"))


def part_checksums(df: DataFrame, part: str) -> DataFrame:
    """part, rows and sum_1, sum_2 over all columns; repeated rows count as often as they occur."""
    hashes = [row_hash(df.columns, s).alias(f"h{s}") for s in SEEDS]
    return (
        df.select(F.col(part).alias("part"), *hashes)
        .groupBy("part")
        .agg(F.count("*").alias("rows"), *[hash_sum(F.col(f"h{s}")).alias(f"sum_{s}") for s in SEEDS])
    )


def differing_parts(left: DataFrame, right: DataFrame, part: str) -> list:
    """The parts whose rows differ or that one side lacks; null is a part like any other."""
    seen: dict = {}
    for side in (left, right):
        for r in part_checksums(side, part).collect():  # one row per part
            seen.setdefault(r["part"], []).append((r["rows"], r["sum_1"], r["sum_2"], side is left))
    same = [p for p, sums in seen.items() if len(sums) == 2 and sums[0][:3] == sums[1][:3]]
    return sorted(seen.keys() - set(same), key=lambda p: (p is not None, p))


def within(part: str, values: Sequence) -> Column:
    """Whether a row lies in one of the parts, null included."""
    known = [v for v in values if v is not None]
    inside = F.col(part).isin(known) if known else F.lit(False)
    return F.coalesce(inside, F.lit(False)) | (F.col(part).isNull() & F.lit(None in values))


def differences(left: DataFrame, right: DataFrame, key: Sequence[str], part: str) -> DataFrame:
    """part, key columns, change, left_rows and right_rows of every key whose rows differ.

    Both tables have the same columns, and all are compared as multisets of rows; nulls equal
    nulls. ``left_rows`` counts a key's rows without an equal on the other side, and ``change``
    is only_left, only_right or changed. Equal tables cost two aggregates. Otherwise the rows of
    the differing parts are counted by value in one shuffle; nothing is joined.
    """
    right = right.select(*(F.col(f"`{c}`") for c in left.columns))
    parts = differing_parts(left, right, part)
    sides = [
        side.where(within(part, parts)).withColumn("_side", F.lit(sign).cast("long"))
        for side, sign in ((left, 1), (right, -1))
    ]
    grouping = list(dict.fromkeys([part, *key]))
    surplus = F.col("_surplus")
    ours, theirs = F.sum(F.greatest(surplus, F.lit(0))), F.sum(F.greatest(-surplus, F.lit(0)))
    change = (
        F.when(F.col("right_rows") == 0, "only_left")
        .when(F.col("left_rows") == 0, "only_right")
        .otherwise("changed")
    )
    return (
        sides[0]
        .unionByName(sides[1])
        .groupBy(*(F.col(f"`{c}`") for c in left.columns))
        .agg(F.sum("_side").alias("_surplus"))
        .where(surplus != 0)
        .groupBy(*grouping)
        .agg(ours.alias("left_rows"), theirs.alias("right_rows"))
        .withColumn("change", change)
    )
