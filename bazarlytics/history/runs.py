"""Run history: rows from artifacts, and reports over the two history tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazarlytics.functions.columns import case, count_where, percent
from bazarlytics.functions.values import MODEL_LAYER_OTHER, MODEL_LAYERS
from bazarlytics.operators.grouping import ordered, top
from bazarlytics.sources.artifacts import read_manifest, read_run_results
from bazarlytics.sources.files import append_table, empty_table
from bazarlytics.sources.schemas import MODEL_HISTORY, RUN_HISTORY

RUN_TABLE, MODEL_TABLE = "run_history", "model_history"


def create_history(spark: SparkSession, folder: str) -> None:
    """Empty, typed history tables."""
    for name, schema in ((RUN_TABLE, RUN_HISTORY), (MODEL_TABLE, MODEL_HISTORY)):
        empty_table(spark, schema).write.mode("errorifexists").parquet(f"{folder}/{name}")


def _known(value: Column | str) -> Column:
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit("unknown"))


def _moment(text: Column | str) -> Column:
    """ISO time text as a plain UTC timestamp."""
    return F.to_timestamp(text).cast("timestamp_ntz")


def run_summary(run_results: DataFrame) -> DataFrame:
    """One row per run; it succeeded when every result did, also when it has none."""

    def of_kind(prefix: str) -> Column:
        found = F.size(F.filter("results", lambda r: r["unique_id"].startswith(prefix)))
        return F.when(F.col("results").isNull(), 0).otherwise(found)

    ended = _moment(F.col("metadata.generated_at"))
    return run_results.select(
        _known("metadata.invocation_id").alias("invocation_id"),
        ended.alias("run_started_at"),
        ended.alias("run_completed_at"),
        _known("args.which").alias("dbt_command"),
        F.coalesce(
            F.forall("results", lambda r: r["status"].isin("success", "pass")), F.lit(True)
        ).alias("success"),
        of_kind("model.").alias("total_models"),
        of_kind("test.").alias("total_tests"),
        F.coalesce("elapsed_time", F.lit(0.0)).alias("total_runtime_seconds"),
        _known("metadata.dbt_version").alias("dbt_version"),
        _known("metadata.target_name").alias("target_name"),
    )


def model_executions(run_results: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row per executed model, described by the manifest's node."""
    steps = F.filter("r.timing", lambda t: t["name"] == "execute")
    models = (
        run_results.select("metadata.invocation_id", F.explode("results").alias("r"))
        .filter(F.col("r.unique_id").startswith("model."))
        .select(
            _known("invocation_id").alias("invocation_id"),
            F.col("r.unique_id").alias("unique_id"),
            _known("r.status").alias("status"),
            F.coalesce(F.get(steps, 0)["duration"], F.lit(0.0)).alias("execution_time_seconds"),
            F.coalesce("r.adapter_response.rows_affected", F.lit(0)).alias("rows_affected"),
            _moment(F.try_element_at("r.timing", F.lit(-1))["completed_at"]).alias("executed_at"),
        )
    )
    own_name = F.element_at(F.split("unique_id", r"\."), -1)
    return models.join(manifest, "unique_id", "left").select(
        "invocation_id",
        F.coalesce("name", own_name).alias("model_name"),
        _known("schema").alias("schema_name"),
        _known("materialized").alias("materialization"),
        "status",
        "execution_time_seconds",
        "rows_affected",
        "executed_at",
        "unique_id",
    )


def log_run(spark: SparkSession, run_path: str, manifest_path: str, folder: str) -> None:
    """Append one run's model executions and then its summary to the history tables.

    The summary completes the run: read_history() leaves out executions without one, so what
    a failure leaves between the two writes is never seen.
    """
    results = read_run_results(spark, run_path)
    append_table(
        model_executions(results, read_manifest(spark, manifest_path)), f"{folder}/{MODEL_TABLE}"
    )
    append_table(run_summary(results), f"{folder}/{RUN_TABLE}")


def read_history(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The logged runs, and the model executions of those runs."""
    logged = spark.read.parquet(f"{folder}/{RUN_TABLE}")
    models = spark.read.parquet(f"{folder}/{MODEL_TABLE}")
    return logged, models.join(logged.select("invocation_id").distinct(), "invocation_id", "left_semi")


def _since(moment: str, days: int, as_of: str | None) -> Column:
    today = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    return F.col(moment) >= F.date_sub(today, days).cast("timestamp_ntz")


def _seconds(aggregate: Column) -> Column:
    return F.round(aggregate, 2)


def history_status(runs: DataFrame, models: DataFrame) -> DataFrame:
    def one(df: DataFrame, name: str, moment: str) -> DataFrame:
        return df.agg(
            F.count("*").alias("row_count"), F.max(moment).alias("latest_record")
        ).select(F.lit(name).alias("table_name"), "row_count", "latest_record")

    return one(runs, RUN_TABLE, "run_started_at").unionByName(
        one(models, MODEL_TABLE, "executed_at")
    )


def latest_totals(runs: DataFrame, as_of: str | None = None, days: int = 7) -> DataFrame:
    return runs.filter(_since("run_started_at", days, as_of)).agg(
        F.sum("total_models").alias("models_run"),
        _seconds(F.sum("total_runtime_seconds")).alias("total_runtime_seconds"),
        count_where(~F.col("success")).alias("failed_runs"),
        F.max("run_started_at").alias("last_run"),
    )


def runtime_trend(runs: DataFrame, as_of: str | None = None, days: int = 30) -> DataFrame:
    return (
        runs.filter(_since("run_started_at", days, as_of))
        .groupBy(F.to_date("run_started_at").alias("run_date"))
        .agg(
            F.sum("total_models").alias("models_executed"),
            _seconds(F.sum("total_runtime_seconds")).alias("runtime_seconds"),
        )
        .transform(ordered, "run_date")
    )


def _averages(models: DataFrame) -> DataFrame:
    return models.groupBy("model_name", "materialization").agg(
        _seconds(F.avg("execution_time_seconds")).alias("avg_seconds"),
        F.count("*").alias("run_count"),
    )


def _succeeded(models: DataFrame) -> DataFrame:
    return models.filter(F.col("status") == "success")


def slowest_models(
    models: DataFrame, as_of: str | None = None, days: int = 7, n: int = 15
) -> DataFrame:
    recent = _succeeded(models).filter(_since("executed_at", days, as_of))
    return top(_averages(recent), n, F.desc("avg_seconds"), "model_name", "materialization")


def model_layer(name: str = "model_name") -> Column:
    return case(
        [(F.col(name).startswith(prefix), layer) for prefix, layer in MODEL_LAYERS],
        MODEL_LAYER_OTHER,
    )


def time_by_layer(models: DataFrame, as_of: str | None = None, days: int = 7) -> DataFrame:
    """Time per layer. A model name lies in one layer, so names are counted after grouping."""
    per_model = (
        _succeeded(models)
        .filter(_since("executed_at", days, as_of))
        .groupBy(model_layer().alias("model_layer"), "model_name")
        .agg(
            F.sum("execution_time_seconds").alias("s"),
            F.count("execution_time_seconds").alias("n"),
        )
    )
    return (
        per_model.groupBy("model_layer")
        .agg(
            F.count("model_name").alias("model_count"),
            _seconds(F.try_divide(F.sum("s"), F.sum("n"))).alias("avg_execution_seconds"),
            _seconds(F.sum("s")).alias("total_execution_seconds"),
        )
        .transform(ordered, F.desc("total_execution_seconds"))
    )


def recent_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    return top(runs, n, F.desc("run_started_at"), "invocation_id").select(
        "invocation_id",
        "dbt_command",
        F.col("run_started_at").alias("run_time"),
        _seconds(F.col("total_runtime_seconds")).alias("runtime_sec"),
        "total_models",
        "success",
    )


def recent_executions(models: DataFrame, n: int = 20) -> DataFrame:
    return top(models, n, F.desc("executed_at"), "invocation_id", "unique_id").select(
        "model_name",
        "materialization",
        "status",
        _seconds(F.col("execution_time_seconds")).alias("execution_seconds"),
        "executed_at",
    )


def slow_executions(models: DataFrame, above_seconds: float = 1.0) -> DataFrame:
    slow = _succeeded(models).filter(F.col("execution_time_seconds") > above_seconds)
    return _averages(slow).orderBy(F.desc("avg_seconds"), "model_name")


def model_over_time(
    models: DataFrame, model_name: str, as_of: str | None = None, days: int = 30
) -> DataFrame:
    return (
        models.filter((F.col("model_name") == model_name) & _since("executed_at", days, as_of))
        .groupBy("model_name", F.to_date("executed_at").alias("execution_date"))
        .agg(
            _seconds(F.avg("execution_time_seconds")).alias("avg_runtime"),
            F.count("*").alias("executions"),
        )
        .transform(ordered, "execution_date")
    )


def runs_by_command(runs: DataFrame) -> DataFrame:
    """Runs, runtime and success rate per command."""
    won = count_where(F.col("success"))
    return (
        runs.groupBy("dbt_command")
        .agg(
            F.count("*").alias("runs"),
            _seconds(F.avg("total_runtime_seconds")).alias("avg_runtime"),
            won.alias("successful_runs"),
            F.round(percent(won, F.count("*")), 2).alias("success_rate_pct"),
        )
        .transform(ordered, F.desc("runs"), "dbt_command")
    )
