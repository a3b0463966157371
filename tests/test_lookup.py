"""Tables written for searches by a single value."""

import os

import pytest

from pyspark.sql import functions as F

from bazarlytics.plans.warehouse import retail_warehouse
from bazarlytics.quality.checks import not_null
from bazarlytics.sources.files import write_table

ROWS = 60_000


@pytest.fixture
def small_groups(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("parquet.block.size", str(64 * 1024))
    yield
    conf.unset("parquet.block.size")


def shop(spark):
    df = spark.range(ROWS).select(F.md5(F.col("id").cast("string")).alias("order_id"), (F.col("id") % 3).alias("month"), "id")
    return df.repartition(2, "id")


def scanned(df):
    """The rows found, and those that the scan let out."""
    rows = df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return rows, scan.metrics().apply("numOutputRows").value()


@pytest.mark.parametrize("partition_by", [None, "month"])
def test_a_search_skips_row_groups(spark, tmp_path, small_groups, partition_by):
    df = shop(spark)
    plain = write_table(df, str(tmp_path / "plain"), partition_by)
    table = write_table(df, str(tmp_path / "t"), partition_by, lookup_by="order_id")
    assert table.count() == ROWS and table.exceptAll(df.select(table.columns)).count() == 0
    wanted = df.where("id = 4321").first().order_id
    (row,), read = scanned(table.where(F.col("order_id") == wanted))
    (same,), read_plain = scanned(plain.where(F.col("order_id") == wanted))
    assert row.id == same.id == 4321
    assert read < ROWS / 10 and read < read_plain


def test_an_absent_value_reads_nothing(spark, tmp_path, small_groups):
    table = write_table(shop(spark), str(tmp_path / "t"), lookup_by="order_id")
    rows, read = scanned(table.where(F.col("order_id") == "8" * 32))
    assert rows == [] and read < ROWS / 100


def test_nulls_and_no_rows(spark, frame, tmp_path):
    rows = [("a", 1), (None, 2), ("a", 1)]
    table = write_table(frame(rows, "order_id string, n int"), str(tmp_path / "n"), lookup_by="order_id")
    assert sorted(map(tuple, table.collect()), key=str) == sorted(rows, key=str)
    assert write_table(frame([], "order_id string, n int"), str(tmp_path / "e"), lookup_by="order_id").count() == 0


def test_a_model_with_checks_is_the_same_rows(spark, tmp_path):
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    rules = [not_null("fct_orders", "order_id")]
    shop = retail_warehouse(spark, folder, path=str(tmp_path / "w"), checks=rules, lookup_by={"fct_orders": "order_id"})
    table = shop["fct_orders"]
    plan = shop.plan("fct_orders").select(table.columns)  # a partition column comes last
    assert table.exceptAll(plan).count() == plan.exceptAll(table).count() == 0
    assert shop.observed == {rules[0].name: 0}
