"""Every registered query against its SQL on the smallest test tables."""

import os

import pytest

from catalog import oracle_statements, spark_queries
from tests.compare import difference, duck, duck_rows, spark_rows

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = spark_queries(), oracle_statements()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    assert difference(spark_rows(QUERIES[name](spark, FOLDER)), duck_rows(con, SQL[name])) is None


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(SQL) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_cohort_matrix_holds_every_cell(spark):
    cells = QUERIES["q19_cohort_retention"](spark, FOLDER).collect()
    wide = {r.cohort_month: r.asDict() for r in QUERIES["q19_cohort_matrix"](spark, FOLDER).collect()}
    assert max(r.months_since_first for r in cells) > 12
    assert all(wide[r.cohort_month][f"month_{r.months_since_first}"] == r.retention_pct for r in cells)
