"""Run queries on Spark and their SQL on DuckDB and compare the rows.

``python -m tests.compare [folder] [name or prefix ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

from bazarlytics.session import local_session
from catalog import oracle_statements, spark_queries


def duck(folder: str):
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def _order(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=_order)


def spark_rows(df):
    return normal(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    result = con.execute(sql)
    return normal([d[0] for d in result.description], result.fetchall())


def difference(left, right) -> str | None:
    """What differs between two normalised results, or None."""
    if left[0] != right[0]:
        return f"columns {sorted(set(left[0]) ^ set(right[0]))}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} rows against {len(right[1])}"
    for a, b in zip(left[1], right[1]):
        if a != b:
            return str([(n, x, y) for n, x, y in zip(left[0], a, b) if x != y][:6])
        kinds = [n for n, x, y in zip(left[0], a, b) if type(x) is not type(y)]
        if kinds:
            return f"types of {kinds[:6]}"
    return None


def main(folder: str, wanted: list[str]) -> int:
    spark, con = local_session(8), duck(folder)
    sql, bad = oracle_statements(), 0
    for name, query in spark_queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.monotonic()
        try:
            ours = spark_rows(query(spark, folder))
            middle = time.monotonic()
            problem = difference(ours, duck_rows(con, sql[name])) if name in sql else "no SQL"
        except Exception as error:  # report and go on with the next query
            ours, middle, problem = ([], []), time.monotonic(), f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        spent = f"{middle - began:5.1f}s {time.monotonic() - middle:5.1f}s"
        print(f"{'ok ' if problem is None else 'BAD'} {name:45s} {len(ours[1]):7d} {spent} {problem or ''}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    args = sys.argv[1:] or ["/root/testdata/sf0.01"]
    sys.exit(main(args[0], args[1:]) > 0)
