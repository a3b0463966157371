"""Run artifacts and reports over the history tables."""

import datetime as dt
import json

import pytest

from pyspark.sql import functions as F

from bazarlytics.history import runs
from bazarlytics.plans.warehouse import Warehouse
from bazarlytics.quality import profile
from bazarlytics.sources import artifacts
from bazarlytics.sources.files import empty_table
from bazarlytics.sources.schemas import MODEL_HISTORY, RAW, RUN_HISTORY


def result(uid, status, seconds=None, rows=None, **more):
    timing = [] if seconds is None else [
        {"name": "compile", "duration": 9.0, "completed_at": "2024-01-30T10:00:00Z"},
        {"name": "execute", "duration": seconds, "completed_at": "2024-01-30T10:00:05.5Z"},
    ]
    return {"unique_id": uid, "status": status, "timing": timing, "adapter_response": {} if rows is None else {"rows_affected": rows}, **more}


@pytest.fixture
def documents(tmp_path):
    run = {
        "metadata": {"invocation_id": "i1", "generated_at": "2024-01-30T10:00:06Z", "dbt_version": "1.9"},
        "args": {"which": "build"},
        "elapsed_time": 6.5,
        "results": [
            result("model.shop.fct_orders", "success", 2.5, 100), result("model.shop.other", "error"),
            result("model.shop.dim_date", "skipped", 0.5), result("test.shop.unique_x.abc", "pass", execution_time=0.1),
            result("test.shop.not_null_y.def", "warn", failures=3, message=" Got 3 results ", execution_time=0.4),
        ],
    }
    manifest = {"nodes": {"model.shop.fct_orders": {"name": "fct_orders", "schema": "core", "config": {"materialized": "table"}}}}
    paths = tmp_path / "run_results.json", tmp_path / "manifest.json"
    for path, document in zip(paths, (run, manifest)):
        path.write_text(json.dumps(document, indent=1))
    return [str(p) for p in paths]


def test_log_run(spark, documents, tmp_path):
    folder = str(tmp_path / "history")
    runs.create_history(spark, folder)
    runs.log_run(spark, *documents, folder)
    run = spark.read.parquet(f"{folder}/run_history").first()
    assert (run.invocation_id, run.dbt_command, run.success, run.target_name) == ("i1", "build", False, "unknown")
    assert (run.total_models, run.total_tests, run.total_runtime_seconds) == (3, 2, 6.5)
    assert run.run_started_at == dt.datetime(2024, 1, 30, 10, 0, 6)
    models = {r.model_name: r for r in spark.read.parquet(f"{folder}/model_history").collect()}
    assert set(models) == {"fct_orders", "other", "dim_date"}
    assert (models["fct_orders"].materialization, models["other"].materialization) == ("table", "unknown")
    assert (models["fct_orders"].execution_time_seconds, models["fct_orders"].rows_affected) == (2.5, 100)
    assert models["other"].executed_at is None and models["other"].execution_time_seconds == 0
    assert models["fct_orders"].executed_at == dt.datetime(2024, 1, 30, 10, 0, 5, 500000)
    runs.log_run(spark, *documents, folder)
    assert spark.read.parquet(f"{folder}/run_history").count() == 2
    assert spark.read.parquet(f"{folder}/run_history").schema == RUN_HISTORY


def test_check_results(spark, documents):
    results = artifacts.check_results(artifacts.read_run_results(spark, documents[0]))
    assert {r.name: (r.status, r.failures, r.message) for r in results.collect()} == {
        "abc": ("pass", 0, None), "def": ("warn", 3, "Got 3 results"),
    }
    assert profile.slowest_checks(results, 1).first().name == "def"


def test_reports_on_empty_tables(spark):
    r, m = empty_table(spark, RUN_HISTORY), empty_table(spark, MODEL_HISTORY)
    assert [x.row_count for x in runs.history_status(r, m).collect()] == [0, 0]
    assert runs.latest_totals(r, "2024-01-01").first().models_run is None
    assert runs.slowest_models(m, "2024-01-01").count() == 0


def test_layers(frame):
    df = frame([("stg_a",), ("int_a",), ("dim_a",), ("fct_a",), ("mart_a",), ("stga",)], "model_name string")
    labels = [r.l for r in df.select(runs.model_layer().alias("l")).collect()]
    assert labels == ["staging", "intermediate", "dimension", "fact", "mart", "other"]


def test_build_times_are_logged(spark, tmp_path):
    raw = {t: (lambda t=t: spark.createDataFrame([], RAW[t])) for t in RAW}
    w = Warehouse(spark, raw, str(tmp_path / "w"))
    w["stg_sellers"]
    w.log_build(str(tmp_path / "model_history"), "i7")
    row = spark.read.parquet(str(tmp_path / "model_history")).first()
    assert (row.model_name, row.status, row.invocation_id) == ("stg_sellers", "success", "i7")


def test_half_logged_run_is_not_seen(spark, documents, tmp_path, monkeypatch):
    folder, append = str(tmp_path / "half"), runs.append_table
    runs.log_run(spark, *documents, folder)
    before = [df.count() for df in runs.read_history(spark, folder)]

    def fails(df, path):
        if path.endswith(runs.RUN_TABLE):
            raise OSError("lost")
        append(df.withColumn("invocation_id", F.lit("other")), path)

    monkeypatch.setattr(runs, "append_table", fails)
    with pytest.raises(OSError):
        runs.log_run(spark, *documents, folder)
    assert [df.count() for df in runs.read_history(spark, folder)] == before


def test_run_without_results_succeeds(spark, documents):
    results = runs.read_run_results(spark, documents[0]).withColumn("results", F.lit(None).cast("array<struct<unique_id:string,status:string>>"))
    row = runs.run_summary(results).first()
    assert (row.success, row.total_models, row.total_tests) == (True, 0, 0)
