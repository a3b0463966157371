"""Queries that have SQL, against it."""

import pytest

from bazarlytics.llm.queries import QUERIES, SQL
from tests.compare import difference, duck, duck_rows, spark_rows

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", SQL)
def test_query(spark, name):
    assert difference(spark_rows(QUERIES[name](spark, FOLDER)), duck_rows(duck(FOLDER), SQL[name])) is None
