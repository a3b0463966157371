"""Data checks. Each one yields the rows that break a rule; no rows means it passes.

Rules come in three kinds. A row rule is a SQL condition on single rows and a total rule a
SQL condition on a table's aggregates: all of these for one table are counted in a single
scan. A set rule needs its own joins or grouping and yields its failing rows as a frame.
Rules on keys are set rules too, but those of all tables are counted together, in one shuffle.

Row and total rules can also be counted while a table is written: a warehouse that is given
checks observes them in the write itself, and the runner then needs no scan for them.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazarlytics.functions.columns import day_gap
from bazarlytics.functions.values import STATE_NAMES
from bazarlytics.operators.grouping import union_all

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Check:
    """A named rule with the severity of a failure and tags to select it by.

    Exactly one of ``row``, ``total`` and ``rows`` is set: the condition of a failing row,
    a condition on aggregates that holds when the table fails, or a function to the
    failing rows. An unknown condition passes. A rule on keys also names its key columns
    in ``keys``, and a reference the (table, column) it points to in ``parent``.
    """

    name: str
    table: str
    row: str | None = None
    total: str | None = None
    rows: Callable[[Tables], DataFrame] | None = None
    keys: tuple[str, ...] = ()
    parent: tuple[str, str] | None = None
    severity: str = "warn"
    tags: tuple[str, ...] = field(default=())

    def failing(self, tables: Tables) -> DataFrame:
        if self.rows is not None:
            return self.rows(tables)
        if self.row is not None:
            return tables[self.table].filter(self.row)
        return tables[self.table].selectExpr(f"{self.total} AS failed").filter("failed")


def literal(value: object) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def _listing(values: Sequence) -> str:
    return ", ".join(literal(x) for x in values)


def _and(condition: str, where: str | None) -> str:
    return f"({condition}) AND ({where})" if where else condition


# --- rules on rows ---------------------------------------------------------------------


def not_null(table: str, column: str, **options) -> Check:
    return Check(f"not_null_{table}_{column}", table, row=f"{column} IS NULL", **options)


def accepted_values(table: str, column: str, values: Sequence, **options) -> Check:
    rule = f"{column} NOT IN ({_listing(values)})"
    return Check(f"accepted_values_{table}_{column}", table, row=rule, **options)


def outside(column: str, low=None, high=None, inclusive: bool = True) -> str:
    """Condition of a known value that lies out of bounds."""
    below, above = ("<", ">") if inclusive else ("<=", ">=")
    bounds = [f"{column} {below} {literal(low)}"] if low is not None else []
    bounds += [f"{column} {above} {literal(high)}"] if high is not None else []
    return " OR ".join(bounds) or "false"


def accepted_range(
    table: str,
    column: str,
    low=None,
    high=None,
    inclusive: bool = True,
    where: str | None = None,
    prefix: str = "accepted_range",
    **options,
) -> Check:
    rule = _and(outside(column, low, high, inclusive), where)
    return Check(f"{prefix}_{table}_{column}", table, row=rule, **options)


def values_between(
    table: str, column: str, low, high, strictly: bool = False, where: str | None = None, **options
) -> Check:
    return accepted_range(
        table, column, low, high, not strictly, where, prefix="values_between", **options
    )


def values_in_set(table: str, column: str, values: Sequence, where: str | None = None, **options):
    rule = _and(f"{column} NOT IN ({_listing(values)})", where)
    return Check(f"values_in_set_{table}_{column}", table, row=rule, **options)


def expression_is_true(table: str, name: str, expression: str, **options) -> Check:
    """A row fails when the expression is false; an unknown result passes."""
    return Check(f"expression_{table}_{name}", table, row=f"NOT ({expression})", **options)


def pair_ordered(table: str, greater: str, lesser: str, or_equal: bool = True, **options) -> Check:
    rule = f"{greater} {'<' if or_equal else '<='} {lesser}"
    return Check(f"pair_ordered_{table}_{greater}_{lesser}", table, row=rule, **options)


# --- rules on totals -------------------------------------------------------------------


def row_count_between(table: str, low: int, high: int, **options) -> Check:
    rule = f"count(*) NOT BETWEEN {low} AND {high}"
    return Check(f"row_count_{table}", table, total=rule, **options)


def at_least_one(table: str, column: str, **options) -> Check:
    rule = f"count({column}) = 0"
    return Check(f"at_least_one_{table}_{column}", table, total=rule, **options)


def recency(table: str, column: str, days: int, as_of: str | None = None, **options) -> Check:
    """Fails when the newest value is more than ``days`` days before ``as_of``."""
    today = f"DATE'{as_of}'" if as_of else "current_date()"
    rule = f"coalesce(datediff({today}, max({column})) > {days}, true)"
    return Check(f"recency_{table}_{column}", table, total=rule, **options)


# --- rules on sets ---------------------------------------------------------------------


def duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Known key values that occur more than once; counts combine before the shuffle."""
    known = df.dropna(subset=list(columns))
    return known.groupBy(*columns).agg(F.count("*").alias("occurrences")).filter("occurrences > 1")


def unique(table: str, *columns: str, **options) -> Check:
    return Check(
        f"unique_{table}_{'_'.join(columns)}",
        table,
        rows=lambda t: duplicates(t[table], columns),
        keys=columns,
        **options,
    )


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose known reference has no parent."""
    keys = parent.select(F.col(parent_column).alias(column))
    return df.filter(F.col(column).isNotNull()).join(keys, column, "left_anti")


def relationships(table: str, column: str, parent: str, parent_column: str, **options) -> Check:
    return Check(
        f"relationships_{table}_{column}",
        table,
        rows=lambda t: orphans(t[table], column, t[parent], parent_column),
        keys=(column,),
        parent=(parent, parent_column),
        **options,
    )


def invalid_values(df: DataFrame, column: str, bad: Column, name: str) -> DataFrame:
    """Distinct failing values with their number of occurrences."""
    return (
        df.filter(F.col(column).isNotNull() & bad)
        .groupBy(F.col(column).alias(name))
        .agg(F.count("*").alias("occurrences"))
    )


def invalid_states(df: DataFrame, column: str) -> DataFrame:
    return invalid_values(df, column, ~F.col(column).isin(*STATE_NAMES), "invalid_state")


def invalid_zip_prefixes(df: DataFrame, column: str) -> DataFrame:
    """Five digits, not below 01000."""
    text = F.col(column).cast("string")
    return invalid_values(df, column, ~text.rlike("^(0[1-9]|[1-9][0-9])[0-9]{3}$"), "invalid_zip")


def invalid_dates(df: DataFrame, column: str, low: str, high: str) -> DataFrame:
    bounds = F.lit(low).cast("date"), F.lit(high).cast("date")
    return invalid_values(
        df, column, ~F.col(column).cast("date").between(*bounds), "invalid_date"
    )


def invalid_percentages(df: DataFrame, column: str, low=0, high=100) -> DataFrame:
    return invalid_values(df, column, F.expr(outside(column, low, high)), "invalid_percentage")


def value_check(name: str, table: str, column: str, find: Callable, *args, **options) -> Check:
    return Check(
        f"{name}_{table}_{column}",
        table,
        rows=lambda t: find(t[table], column, *args),
        **{"severity": "error", **options},
    )


def valid_state(table: str, column: str, **options) -> Check:
    return value_check("valid_state", table, column, invalid_states, **options)


def valid_zip_prefix(table: str, column: str, **options) -> Check:
    return value_check("valid_zip_prefix", table, column, invalid_zip_prefixes, **options)


def date_range_valid(
    table: str, column: str, low: str = "2016-01-01", high: str = "2019-12-31", **options
) -> Check:
    return value_check("date_range_valid", table, column, invalid_dates, low, high, **options)


def percentage_range(table: str, column: str, low=0, high=100, **options) -> Check:
    return value_check("percentage_range", table, column, invalid_percentages, low, high, **options)


def aggregate_equals(
    left: DataFrame,
    left_expression: str,
    right: DataFrame,
    right_expression: str,
    tolerance: float = 0.0,
) -> DataFrame:
    """One row when two totals differ by more than the tolerance."""
    other = right.agg(F.expr(right_expression).cast("double").alias("b"))
    both = left.agg(F.expr(left_expression).cast("double").alias("expression")).withColumn(
        "compare_expression", other.scalar()
    )
    gap = F.abs(F.col("expression") - F.col("compare_expression"))
    return both.filter(F.coalesce(gap > tolerance, F.lit(True)))


def columns_match(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Columns that are missing, unexpected or out of place, one row each."""
    width = max(len(df.columns), len(expected))
    pairs = [
        (i + 1, want, got)
        for i, (want, got) in enumerate(
            zip(_padded(expected, width), _padded(df.columns, width))
        )
        if want != got
    ]
    return df.sparkSession.createDataFrame(pairs, "position int, expected string, actual string")


def _padded(names: Sequence[str], width: int) -> list[str | None]:
    return list(names) + [None] * (width - len(names))


def type_mismatch(df: DataFrame, column: str, expected: str) -> DataFrame:
    actual = df.schema[column].dataType.simpleString()
    rows = [] if actual == expected else [(column, expected, actual)]
    return df.sparkSession.createDataFrame(rows, "column string, expected string, actual string")


def column_type(table: str, column: str, expected: str, **options) -> Check:
    return Check(
        f"column_type_{table}_{column}",
        table,
        rows=lambda t: type_mismatch(t[table], column, expected),
        **options,
    )


def column_order(table: str, expected: Sequence[str], **options) -> Check:
    return Check(
        f"column_order_{table}", table, rows=lambda t: columns_match(t[table], expected), **options
    )


# --- running ---------------------------------------------------------------------------


def select(checks: Sequence[Check], *tags: str, severity: str | None = None) -> list[Check]:
    """Checks that carry any of the tags, and the severity if one is given."""
    return [
        c
        for c in checks
        if (not tags or set(tags) & set(c.tags)) and severity in (None, c.severity)
    ]


def scan_counts(checks: Sequence[Check]) -> dict[str, str]:
    """The number of failures of every row and total rule, by name, as an aggregate in SQL."""
    return {
        c.name: f"count_if({c.row})" if c.row is not None else f"bigint(if({c.total}, 1, 0))"
        for c in checks
        if c.rows is None
    }


def _known(tables: Tables, names: Sequence[str]) -> dict[str, int]:
    """Counts that the tables' own write has already observed."""
    seen = getattr(tables, "observed", {})
    return {n: seen[n] for n in names if n in seen}


def _listed(source: DataFrame, counts: Mapping[str, object]) -> DataFrame:
    """One row (name, failures) per entry, from a frame of one row or of aggregates."""
    pairs = ", ".join(f"{literal(name)}, {count}" for name, count in counts.items())
    return source.selectExpr(f"stack({len(counts)}, {pairs}) AS (name, failures)")


def scan_failures(checks: Sequence[Check], tables: Tables) -> list[DataFrame]:
    """Frames (name, failures) of the row and total rules: one scan for each table of which
    the write did not observe them."""
    parts: list[DataFrame] = []
    for table in dict.fromkeys(c.table for c in checks if c.rows is None):
        counts: dict[str, object] = scan_counts([c for c in checks if c.table == table])
        df = tables[table]
        known = _known(tables, list(counts))
        if known:
            one = df.sparkSession.range(1)
            parts.append(_listed(one, {n: f"{k}L" for n, k in known.items()}))
        if rest := {n: e for n, e in counts.items() if n not in known}:
            parts.append(_listed(df, rest))
    return parts


def _key(columns: Sequence[str]) -> Column:
    """A key as text, null if a part is unknown; lengths keep the parts of a pair apart."""
    texts = [F.col(c).cast("string") for c in columns]
    if len(texts) == 1:
        return texts[0]
    return F.concat(*(part for t in texts for part in (F.length(t).cast("string"), F.lit(":"), t)))


def key_failures(checks: Sequence[Check], tables: Tables) -> DataFrame:
    """One row (name, failures) for each rule on keys, from one scan per table and one shuffle.

    Every key space, the columns of a table that must be unique or are referred to, has a
    number. Tables send their own keys with slot 0 and their references with the slot of
    the rule, counts combine before the shuffle, and a key's counts then show both its
    repetitions and the references it is missing for.
    """
    spaces: dict[tuple[str, tuple[str, ...]], dict[int, str]] = {}
    sent: dict[str, list[Column]] = {}

    def send(table: str, space: int, slot: int, columns: Sequence[str]) -> None:
        entry = F.struct(F.lit(space).alias("space"), F.lit(slot).alias("slot"), _key(columns).alias("key"))
        sent.setdefault(table, []).append(entry)

    for c in checks:
        own = (c.parent[0], (c.parent[1],)) if c.parent else (c.table, c.keys)
        if own not in spaces:
            spaces[own] = {}
            send(own[0], list(spaces).index(own), 0, own[1])
        slots = spaces[own]
        slot = max([0, *slots]) + 1 if c.parent else 0
        slots[slot] = c.name
        if c.parent:
            send(c.table, list(spaces).index(own), slot, c.keys)
    streams = [
        tables[table].select(F.inline(F.array(*entries))).where("key IS NOT NULL")
        for table, entries in sent.items()
    ]
    width = 1 + max(slot for slots in spaces.values() for slot in slots)
    counts = union_all(streams).groupBy("space", "key").agg(
        *(F.count_if(F.col("slot") == i).alias(f"n{i}") for i in range(width))
    )
    orphan = [F.sum(F.when(F.col("n0") == 0, F.col(f"n{i}")).otherwise(0)) for i in range(1, width)]
    found = counts.groupBy("space").agg(
        F.array(F.count_if(F.col("n0") > 1), *(F.coalesce(o, F.lit(0)) for o in orphan)).alias("failures")
    )
    names = [(i, slot, name) for i, slots in enumerate(spaces.values()) for slot, name in slots.items()]
    rules = streams[0].sparkSession.range(1).selectExpr(
        "inline(array(" + ", ".join(f"struct({i} AS space, {s} AS slot, {literal(n)} AS name)" for i, s, n in names) + "))"
    )
    failures = F.coalesce(F.get("failures", F.col("slot")), F.lit(0)).cast("long")
    return rules.join(found, "space", "left").select("name", failures.alias("failures"))


def set_failures(check: Check, tables: Tables) -> DataFrame:
    counted = check.rows(tables).agg(F.count("*").alias("failures"))
    return counted.select(F.lit(check.name).alias("name"), "failures")


def _gather(checks: Sequence[Check], tables: Tables) -> None:
    """Have a warehouse write what the checks read, with independent tables at the same time."""
    together = getattr(tables, "together", None)
    if together is None:
        return
    named = dict.fromkeys([c.table for c in checks] + [c.parent[0] for c in checks if c.parent])
    rules = [c.rows for c in checks if c.rows is not None and not c.keys]  # these may read further tables
    together([*((lambda n=n: tables[n]) for n in named), *((lambda r=r: r(tables)) for r in rules)])


def failure_counts(checks: Sequence[Check], tables: Tables) -> DataFrame:
    """One row (name, failures) per check.

    Row and total rules of a table share one scan and one aggregation, or none if the table's
    write observed them; rules on keys share one shuffle.
    """
    _gather(checks, tables)
    parts = scan_failures(checks, tables)
    if keyed := [c for c in checks if c.keys]:
        parts.append(key_failures(keyed, tables))
    parts += [set_failures(c, tables) for c in checks if c.rows is not None and not c.keys]
    return union_all(parts)


def run_checks(checks: Sequence[Check], tables: Tables) -> DataFrame:
    """Summary (name, severity, failures, status) with status pass, warn or fail."""
    names = [c.name for c in checks]
    if len(names) != len(set(names)):
        raise ValueError("check names must be unique")
    return _judged(failure_counts(checks, tables), checks)


def _judged(counts: DataFrame, checks: Sequence[Check]) -> DataFrame:
    serious = [c.name for c in checks if c.severity == "error"]
    severity = F.when(F.col("name").isin(serious), "error").otherwise("warn")
    status = (
        F.when(F.col("failures") == 0, "pass")
        .when(F.col("severity") == "error", "fail")
        .otherwise("warn")
    )
    kept = [c for c in counts.columns if c not in ("name", "failures")]
    return counts.withColumn("severity", severity).select(
        "name", "severity", "failures", status.alias("status"), *kept
    )


def timed_checks(checks: Sequence[Check], tables: Tables) -> DataFrame:
    """The summary of run_checks() with the seconds that each check's job took.

    Rules that share a job share its seconds: those of one table's scan, and all rules on
    keys. There is one row per check, so what comes to the driver does not grow with the data.
    """
    _gather(checks, tables)
    scans = {t: [c for c in checks if c.table == t and c.rows is None] for t in dict.fromkeys(c.table for c in checks)}
    groups: list[Callable[[], DataFrame]] = [
        (lambda mine=mine: union_all(scan_failures(mine, tables))) for mine in scans.values() if mine
    ]
    if keyed := [c for c in checks if c.keys]:
        groups.append(lambda: key_failures(keyed, tables))
    groups += [(lambda c=c: set_failures(c, tables)) for c in checks if c.rows is not None and not c.keys]
    rows, spark = [], None
    for group in groups:
        began = time.monotonic()
        counted = group()
        found = counted.collect()
        spent, spark = time.monotonic() - began, counted.sparkSession
        rows += [(r["name"], r["failures"], spent) for r in found]
    return _judged(spark.createDataFrame(rows, "name string, failures long, seconds double"), checks)


def store_failures(check: Check, tables: Tables, folder: str) -> str:
    """Write a check's failing rows under ``test_failures`` and return the path."""
    path = f"{folder.rstrip('/')}/test_failures/{check.name}"
    check.failing(tables).write.mode("overwrite").parquet(path)
    return path


def freshness(
    df: DataFrame, source: str, column: str, warn_days: int, error_days: int, as_of: str
) -> DataFrame:
    """Age of the newest row in days and whether that passes, warns or fails."""
    age = F.col("age_days")
    return df.agg(day_gap(F.max(column), F.lit(as_of).cast("date")).alias("age_days")).select(
        F.lit(source).alias("source"),
        "age_days",
        F.when(age.isNull() | (age > error_days), "error")
        .when(age > warn_days, "warn")
        .otherwise("pass")
        .alias("status"),
    )
