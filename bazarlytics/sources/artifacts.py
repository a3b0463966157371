"""Run artifacts: nested JSON documents with the outcome of a build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RUN_RESULTS = """
    metadata struct<invocation_id: string, generated_at: string, dbt_version: string, target_name: string>,
    args struct<which: string>,
    elapsed_time double,
    results array<struct<
        unique_id: string, status: string, execution_time: double, failures: bigint, message: string,
        timing: array<struct<name: string, duration: double, started_at: string, completed_at: string>>,
        adapter_response: struct<rows_affected: int>>>
"""
_MANIFEST = "nodes map<string, struct<name: string, schema: string, config: struct<materialized: string>>>"


def read_run_results(spark: SparkSession, path: str) -> DataFrame:
    """One row per run document; a folder of documents is read in parallel."""
    return spark.read.schema(_RUN_RESULTS).option("multiLine", True).json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per described node."""
    documents = spark.read.schema(_MANIFEST).option("multiLine", True).json(path)
    return documents.select(F.explode("nodes").alias("unique_id", "node")).select(
        "unique_id", "node.name", "node.schema", F.col("node.config.materialized").alias("materialized")
    )


def check_results(run_results: DataFrame) -> DataFrame:
    """Results of checks as (name, status, failures, seconds, message)."""
    return (
        run_results.select(F.explode("results").alias("r"))
        .filter(F.col("r.unique_id").startswith("test."))
        .select(
            F.element_at(F.split("r.unique_id", r"\."), -1).alias("name"),
            F.col("r.status").alias("status"),
            F.coalesce("r.failures", F.lit(0)).alias("failures"),
            F.col("r.execution_time").alias("seconds"),
            F.trim("r.message").alias("message"),
        )
    )
