"""Helpers that render SQL text from fixed values and put numbers into comparable form."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from bazarlytics.functions.values import Ladder


def quote(value: object) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def listing(values: Iterable[object]) -> str:
    return "(" + ", ".join(quote(x) for x in values) + ")"


def ladder(expr: str, steps: Ladder) -> str:
    branches = [f"WHEN {expr} {steps.op} {bound} THEN {quote(label)}" for bound, label in steps.steps]
    if steps.null is not None:
        branches.insert(0, f"WHEN {expr} IS NULL THEN {quote(steps.null)}")
    return f"CASE {' '.join(branches)} ELSE {quote(steps.otherwise)} END"


def mapping(expr: str, table: Mapping[object, object], otherwise: str = "NULL") -> str:
    branches = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items())
    return f"CASE {expr} {branches} ELSE {otherwise} END"


def membership(expr: str, groups: Mapping[str, Sequence[str]], otherwise: str) -> str:
    branches = " ".join(
        f"WHEN {expr} IN {listing(members)} THEN {quote(name)}" for name, members in groups.items()
    )
    return f"CASE {branches} ELSE {quote(otherwise)} END"


def num(expr: str, name: str | None = None) -> str:
    """A number as a double with four decimals; the nudge settles exact halves alike."""
    return f"round(CAST({expr} AS DOUBLE) + 1e-7, 4) AS {name or expr}"


def day(expr: str, name: str | None = None) -> str:
    return f"CAST(CAST({expr} AS DATE) AS VARCHAR) AS {name or expr}"


def moment(expr: str, name: str | None = None) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') AS {name or expr}"


def whole(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS BIGINT) AS {name or expr}"


def pct(hits: str, total: str = "count(*)") -> str:
    """Percentage as a double, NULL when the total is not above zero."""
    return f"CASE WHEN {total} > 0 THEN 100.0 * CAST({hits} AS DOUBLE) / {total} END"


def per(amount: str, units: str) -> str:
    return f"CASE WHEN {units} > 0 THEN CAST({amount} AS DOUBLE) / {units} END"
