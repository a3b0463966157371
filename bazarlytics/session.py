"""Session settings and the shared folder for tables that must outlive an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the transforms rely on. Skewed joins are split by AQE even when
# that costs a further exchange, because one key may hold a large share of the rows.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # columns of ids and labels shrink well, and what is written once is read several times
    "spark.sql.parquet.compression.codec": "zstd",
    # tables in buckets of an order meet in place, also where they join on the order and a further key
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # a task that writes one bucket does not sort its rows for it
    "spark.sql.maxConcurrentOutputFileWriters": "8",
}

# AQE merges shuffle partitions up to this many compressed bytes, but a task sorts and joins the rows
# unpacked, about nine times as large in the order fact. At Spark's 64 MB such a task held 580 MB.
TABLE_CONF = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}

_local_dirs: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in (RUNTIME_CONF | TABLE_CONF).items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bazarlytics")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Only a local session may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        _local_dirs[app] = tempfile.mkdtemp(prefix="bazarlytics-")
    return _local_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; never reused, so nothing has to be deleted."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/bazarlytics/{app}/{name}-{uuid.uuid4().hex[:12]}"


def freeze(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage: the rows and their order stay as computed once."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
