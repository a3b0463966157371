"""Raw files, stored tables and the whole build from CSV."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bazarlytics.analyses.common import in_period
from bazarlytics.plans.warehouse import MODELS, StoredTables, csv_warehouse
from bazarlytics.sources import files
from bazarlytics.sources.schemas import RAW
from tests.test_models import CATEGORIES, CUSTOMERS, PRODUCTS, SELLERS, item, order, pay, review


def write(folder, name, *lines):
    (folder / f"{name}.csv").write_text("\n".join(lines) + "\n")


def test_zip_prefixes_keep_leading_zeros(spark, tmp_path):
    write(tmp_path, "sellers", "seller_id,seller_zip_code_prefix,seller_city,seller_state", "s1,01037,sp,SP", "s2,1037,sp,SP", 's3,"99999",x,')
    rows = files.read_raw_csv(spark, str(tmp_path), "sellers").collect()
    assert [r.seller_zip_code_prefix for r in rows] == ["01037", "01037", "99999"]
    assert rows[2].seller_state is None


def test_free_text_spans_lines(spark, tmp_path):
    header = ",".join(RAW["reviews"].names)
    write(tmp_path, "reviews", header, 'r1,o1,5,"a ""b"", c","line one', 'line two",2018-01-02 00:00:00,2018-01-03 10:11:12', "r2,o2,1,,,2018-01-02 00:00:00,")
    rows = files.read_raw_csv(spark, str(tmp_path), "reviews").collect()
    assert len(rows) == 2 and rows[0].review_comment_message == "line one\nline two" and rows[0].review_comment_title == 'a "b", c'
    assert rows[0].review_answer_timestamp == dt.datetime(2018, 1, 3, 10, 11, 12) and rows[1].review_comment_title is None


def test_corrupt_rows_are_kept_apart(spark, tmp_path):
    write(tmp_path, "payments", ",".join(RAW["payments"].names), "o1,1,boleto,1,10.50", "o2,x,boleto,1,oops")
    df = files.read_raw_csv(spark, str(tmp_path), "payments", keep_corrupt=True).cache()
    assert df.filter(F.col(files.CORRUPT).isNotNull()).count() == 1 and df.count() == 2


def test_columns_are_found_by_their_names(spark, tmp_path):
    names = RAW["payments"].names
    write(tmp_path, "payments", ",".join([names[2], "extra", *names[:2], *names[3:]]), "boleto,zzz,o1,1,2,10.50")
    (row,) = files.read_raw_csv(spark, str(tmp_path), "payments").collect()
    assert row.asDict() == dict(zip(names, ["o1", 1, "boleto", 2, row[4]])) and float(row[4]) == 10.5
    write(tmp_path, "payments", ",".join(names[:-1]), "o1,1,boleto,2")
    with pytest.raises(ValueError, match=names[-1]):
        files.read_raw_csv(spark, str(tmp_path), "payments")


def test_malformed_rows_are_counted_per_source(spark, tmp_path):
    for table in RAW:
        write(tmp_path, table, ",".join(RAW[table].names))
    write(tmp_path, "payments", ",".join(RAW["payments"].names), "o1,1,boleto,1,10.50", "o2,x,boleto,1,oops")
    orders = ["o1,c1,delivered,2017-13-45 99:00:00,,,,"]
    write(tmp_path, "orders", ",".join(RAW["orders"].names), *orders)
    counts = {r.source: (r.rows, r.malformed_rows) for r in files.malformed_rows(spark, str(tmp_path)).collect()}
    assert counts == {t: (0, 0) for t in RAW} | {"payments": (2, 1), "orders": (1, 1)}


def test_partitioned_table_prunes_months(spark, tmp_path):
    df = spark.range(400).select(
        F.col("id").cast("string").alias("order_id"), F.date_add(F.lit("2017-01-01").cast("date"), F.col("id").cast("int")).alias("order_date")
    ).withColumn("order_month", F.trunc("order_date", "month"))
    table = files.write_table(df, str(tmp_path / "t"), "order_month")
    assert table.count() == 400 and set(table.columns) == set(df.columns)
    plan = in_period(table, "2017-02-10", "2017-03-05")._jdf.queryExecution().executedPlan().toString()
    filters = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "order_month" in filters.split("PartitionFilters")[1] and "PushedFilters: [" in plan
    assert in_period(table, "2017-02-10", "2017-03-05").count() == 24


def test_append_and_listing(spark, tmp_path):
    path = str(tmp_path / "h")
    for n in (1, 2):
        files.append_table(spark.range(n), path)
    assert spark.read.parquet(path).count() == 3
    files.register_views({"some_view": spark.range(1)})
    assert "some_view" in files.list_tables(spark)


def test_literal_rows_and_filter(spark):
    rows = spark.createDataFrame([(1,), (None,)], "id int")
    assert [r.id for r in rows.filter("id = 1").collect()] == [1]


@pytest.fixture
def csv_folder(spark, tmp_path):
    rows = {
        "orders": [order(1), order(2, customer="c2", days=3)], "customers": CUSTOMERS, "sellers": SELLERS, "products": PRODUCTS,
        "category_translation": CATEGORIES, "order_items": [item(1), item(2)], "payments": [pay(1), pay(2)],
        "reviews": [review(1, message="fine\nreally"), review(2, score=1)],
    }
    for table, schema in RAW.items():
        df = spark.createDataFrame(rows.get(table, []), schema)
        df.toPandas().to_csv(tmp_path / f"{table}.csv", index=False)
    return str(tmp_path)


def test_build_from_csv(spark, csv_folder, tmp_path):
    w = csv_warehouse(spark, csv_folder, path=str(tmp_path / "built"), as_of="2018-04-01")
    seconds = w.build()
    assert set(seconds) == {m for m in MODELS if not m.startswith("int_")}
    assert w["fct_orders"].count() == 2 and w["mart_customer_analytics"].count() == 2
    assert w["dim_customers"].filter("customer_id = 'c1'").first().days_since_last_order == 22
    stored = StoredTables(spark, str(tmp_path / "built"))
    assert set(stored) == set(seconds) and stored["fct_orders"].count() == 2
    with pytest.raises(KeyError):
        stored["int_orders_enriched"]
    spark.sql("CREATE DATABASE IF NOT EXISTS shop_test")
    w.publish("shop_test")
    assert spark.sql("SELECT sum(item_count) AS n FROM shop_test.fct_orders WHERE order_month = '2018-03-01'").first().n == 2
    assert "mart_seller_scorecard" in files.list_tables(spark, "shop_test")
    spark.sql("DROP DATABASE shop_test CASCADE")
    w.register_views()
    assert spark.sql("SELECT sum(total_order_value) AS v FROM fct_orders").first().v == 220
