"""Column expressions shared by the transforms. All are built-in functions, no UDFs."""

from __future__ import annotations

import operator
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from bazarlytics.functions.values import SURROGATE_NULL, Ladder

_COMPARE = {">=": operator.ge, ">": operator.gt, "<=": operator.le, "<": operator.lt}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tier(value: Column | str, ladder: Ladder) -> Column:
    """Label a value with the first ladder step it satisfies."""
    value = col(value)
    compare = _COMPARE[ladder.op]
    branches = [(compare(value, F.lit(bound)), label) for bound, label in ladder.steps]
    if ladder.null is not None:
        branches.insert(0, (value.isNull(), ladder.null))
    return case(branches, ladder.otherwise)


def case(branches: Iterable[tuple[Column, object]], otherwise: object = None) -> Column:
    """First matching branch; NULL when nothing matches and no default is given."""
    chain = None
    for condition, result in branches:
        chain = F.when(condition, result) if chain is None else chain.when(condition, result)
    return chain if otherwise is None else chain.otherwise(otherwise)


def position(value: Column | str, labels: Sequence[str]) -> Column:
    """1-based place of a label in a list, one past the end for any other label."""
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), col(value))
    return F.when(place > 0, place).otherwise(len(labels) + 1).cast("int")


def lookup(value: Column | str, mapping: Mapping[object, object], otherwise: Column | object = None):
    """Map a value through a small fixed table."""
    value = col(value)
    return case([(value == F.lit(k), F.lit(v)) for k, v in mapping.items()], otherwise)


def group_of(value: Column | str, groups: Mapping[str, Sequence[str]], otherwise: str) -> Column:
    """Name of the list a value belongs to."""
    value = col(value)
    return case([(value.isin(*members), name) for name, members in groups.items()], otherwise)


def flag(condition: Column) -> Column:
    """A boolean that is never NULL."""
    return F.coalesce(condition, F.lit(False))


def zero(value: Column | str) -> Column:
    return F.coalesce(col(value), F.lit(0))


def ratio(numerator: Column | str, denominator: Column | str, scale: float = 1.0) -> Column:
    """Quotient as a double, NULL unless the denominator is above zero."""
    num, den = col(numerator).cast("double"), col(denominator).cast("double")
    return F.when(den > 0, num / den * F.lit(float(scale)))


def percent(numerator: Column | str, denominator: Column | str) -> Column:
    return ratio(numerator, denominator, 100.0)


def mean(value: Column | str) -> Column:
    """Average in double precision, whatever the input type."""
    return F.avg(col(value).cast("double"))


def weighted_mean(value_sum: Column | str, weight_sum: Column | str) -> Column:
    return ratio(value_sum, weight_sum)


def share_where(condition: Column) -> Column:
    """Percentage of the group's rows that satisfy a condition."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0)) * 100.0


def count_where(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def sum_where(condition: Column, value: Column | str) -> Column:
    return F.sum(F.when(condition, col(value)).otherwise(0))


def any_true(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def bits(conditions: Iterable[Column]) -> Column:
    """Conditions as one number with a bit for each that holds, which moves as one column."""
    return add_all(F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(conditions))


def any_bit(number: str, names: Iterable[str]) -> list[Column]:
    """Aggregates: for each name in turn whether its bit is set in any of the numbers."""
    return [
        (F.bit_or(number).bitwiseAND(F.lit(1 << i)) != 0).alias(name) for i, name in enumerate(names)
    ]


def hours_between(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", col(start), col(end)) / F.lit(3.6e9)


def days_between(start: Column | str, end: Column | str) -> Column:
    """Elapsed time in fractional days."""
    return F.timestamp_diff("MICROSECOND", col(start), col(end)) / F.lit(8.64e10)


def day_gap(start: Column | str, end: Column | str) -> Column:
    """Number of midnights between two moments, negative when they run backwards."""
    return F.datediff(F.to_date(col(end)), F.to_date(col(start)))


def month_gap(start: Column | str, end: Column | str) -> Column:
    """Calendar months between two dates, ignoring the day of month."""
    start, end = col(start), col(end)
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def date_key(moment: Column | str) -> Column:
    """A day as the integer YYYYMMDD."""
    day = col(moment)
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def day_of_week(moment: Column | str) -> Column:
    """Sunday is 0, Saturday is 6."""
    return F.dayofweek(col(moment)) - 1


def month_start(moment: Column | str) -> Column:
    return F.trunc(F.to_date(col(moment)), "month")


def surrogate_key(*parts: Column | str) -> Column:
    texts = [F.coalesce(col(p).cast("string"), F.lit(SURROGATE_NULL)) for p in parts]
    return F.md5(F.concat_ws("-", *texts).cast("binary"))


def add_all(columns: Iterable[Column]) -> Column:
    return reduce(operator.add, columns)


def either(columns: Iterable[Column]) -> Column:
    return reduce(operator.or_, columns)


def money(value: Column | str) -> Column:
    return col(value).cast("decimal(10,2)")


def clean_state(value: Column | str) -> Column:
    return F.upper(F.trim(col(value)))
