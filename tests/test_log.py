"""The shared log of runs: entries whole, compactions without repeats or losses."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest

from bazarlytics.history import log
from bazarlytics.sources.files import empty_table
from bazarlytics.sources.schemas import MODEL_HISTORY, RUN_HISTORY

MOMENT = dt.datetime(2024, 1, 30, 10)


def rows(spark, *names, models=3):
    ran = [(n, MOMENT, MOMENT, "build", True, models, 0, 1.5, "1", "prod") for n in names]
    built = [(n, f"m{i}", "core", "table", "success", 0.5, 1, MOMENT, f"model.shop.m{i}") for n in names for i in range(models)]
    return spark.createDataFrame(ran, RUN_HISTORY), spark.createDataFrame(built, MODEL_HISTORY)


def seen(spark, folder):
    runs, models = log.read_log(spark, folder)
    assert (runs.schema, models.schema) == (RUN_HISTORY, MODEL_HISTORY)
    names = sorted(r.invocation_id for r in runs.collect())
    per_run = sorted(r.invocation_id for r in models.collect())
    return names, per_run


def expected(*names, models=3):
    return sorted(names), sorted(n for n in names for _ in range(models))


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "log")


def test_empty_log(spark, folder):
    assert seen(spark, folder) == ([], [])
    assert log.compact(spark, folder) is None and log.release(spark, folder) == []


def test_concurrent_writers_lose_nothing(spark, folder):
    names = [f"r{i}" for i in range(8)]
    with ThreadPoolExecutor(4) as pool:
        entries = list(pool.map(lambda n: log.log_rows(*rows(spark, n), folder), names))
    assert len(set(entries)) == 8 and log.parts(spark, folder) == sorted(entries)
    assert seen(spark, folder) == expected(*names)


def test_compaction_keeps_rows_and_releases_parts(spark, folder):
    for n in ("a", "b", "b"):  # a run may be logged twice
        log.log_rows(*rows(spark, n), folder)
    part = log.compact(spark, folder)
    assert seen(spark, folder) == expected("a", "b", "b")
    log.log_rows(*rows(spark, "c"), folder)
    assert len(log.release(spark, folder)) == 3
    assert len(log.parts(spark, folder)) == 2 and part in log.parts(spark, folder)
    assert seen(spark, folder) == expected("a", "b", "b", "c")
    log.compact(spark, folder)
    log.release(spark, folder)
    assert len(log.parts(spark, folder)) == 1 and seen(spark, folder) == expected("a", "b", "b", "c")


def test_two_compactions_and_a_writer_at_once(spark, folder):
    for n in ("a", "b"):
        log.log_rows(*rows(spark, n), folder)
    with ThreadPoolExecutor(3) as pool:
        jobs = [pool.submit(log.compact, spark, folder) for _ in range(2)]
        jobs.append(pool.submit(log.log_rows, *rows(spark, "c"), folder))
        assert all(j.result() for j in jobs)
    assert seen(spark, folder) == expected("a", "b", "c")
    log.release(spark, folder)
    assert seen(spark, folder) == expected("a", "b", "c")


def test_overlapping_parts_lose_nothing(spark, folder):
    """One compaction saw two entries, a later one by name only the second of them and a third."""
    names = [log.log_rows(*rows(spark, n), folder) for n in ("a", "b", "c")]
    for part, held in (("000001-x", names[:2]), ("000001-y", names[1:])):
        tables = log._visible(spark, folder, held)
        log._publish({n: df.drop(log.PART) for n, df in tables.items()}, folder, part)
    assert seen(spark, folder) == expected("a", "b", "c")
    assert sorted(log.release(spark, folder)) == sorted(names)
    assert seen(spark, folder) == expected("a", "b", "c")


def test_broken_write_is_not_seen(spark, folder, monkeypatch):
    log.log_rows(*rows(spark, "a"), folder)
    runs, models = rows(spark, "b")

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(log, "_publish", lambda tables, *at: tables[log.RUN_TABLE].write.parquet(f"{at[0]}/staged/{at[1]}/run_history") or lost())
        with pytest.raises(OSError):
            log.log_rows(runs, models, folder)
    assert seen(spark, folder) == expected("a")
    log.log_rows(runs, models, folder)
    assert seen(spark, folder) == expected("a", "b")


def test_run_without_models_and_models_without_run(spark, folder):
    log.log_rows(rows(spark, "a")[0], empty_table(spark, MODEL_HISTORY), folder)
    log.log_rows(empty_table(spark, RUN_HISTORY), rows(spark, "b")[1], folder)
    assert seen(spark, folder) == (["a"], [])


def test_extra_columns_are_left_out(spark, folder):
    runs, models = rows(spark, "a")
    log.log_rows(runs.selectExpr("*", "1 AS log_part"), models.selectExpr("*", "2 AS log_entry"), folder)
    assert seen(spark, folder) == expected("a")
