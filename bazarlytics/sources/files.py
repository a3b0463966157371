"""Readers for the nine raw CSV files and readers and writers for warehouse tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazarlytics.operators.grouping import union_all
from bazarlytics.sources.schemas import RAW

CORRUPT = "_corrupt_record"

# file name of each raw table inside the source folder; pass another mapping where it differs
CSV_FILES = {name: f"{name}.csv" for name in RAW}

_ZIP_COLUMNS = {
    "customers": "customer_zip_code_prefix",
    "sellers": "seller_zip_code_prefix",
    "geolocation": "geolocation_zip_code_prefix",
}


def read_raw_csv(
    spark: SparkSession,
    folder: str,
    table: str,
    files: Mapping[str, str] = CSV_FILES,
    keep_corrupt: bool = False,
) -> DataFrame:
    """Scan one raw CSV; columns are found by their header names and have declared types.

    Zip prefixes are text, so leading zeros survive. Quoted free text may span lines. A column
    that the header lacks is an error, one that is not declared is left out, and every part
    file must have the header of the first. Rows that do not parse keep their raw line in
    ``_corrupt_record`` when asked for; all columns are then parsed.
    """
    declared = RAW[table]
    path = f"{folder.rstrip('/')}/{files[table]}"
    options = {"header": True, "escape": '"', "mode": "PERMISSIVE", "enforceSchema": False}
    if table == "reviews":
        options["multiLine"] = True
    header = spark.read.options(header=True, escape='"', multiLine=table == "reviews").csv(path).columns
    missing = [f.name for f in declared if f.name not in header]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    known = {f.name: f for f in declared}
    schema = T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in header])
    kept = list(known)
    if keep_corrupt:
        schema = schema.add(CORRUPT, T.StringType())
        options |= {"columnNameOfCorruptRecord": CORRUPT, "columnPruning": False}
        kept.append(CORRUPT)
    df = spark.read.options(**options).schema(schema).csv(path).select(*kept)
    zip_column = _ZIP_COLUMNS.get(table)
    if zip_column:
        df = df.withColumn(zip_column, F.lpad(zip_column, 5, "0"))
    return df


def malformed_rows(spark: SparkSession, folder: str, files: Mapping[str, str] = CSV_FILES) -> DataFrame:
    """source, rows and malformed rows (a cell that does not parse) of every raw CSV."""
    counts = []
    for table in RAW:
        df = read_raw_csv(spark, folder, table, files, keep_corrupt=True)
        # all cells are named, since Spark parses and checks only those that a query names
        cells = F.length(F.concat_ws("", *(F.col(c).cast("string") for c in df.columns if c != CORRUPT)))
        bad = F.col(CORRUPT).isNotNull() & (cells >= 0)
        counts.append(
            df.agg(F.count("*").alias("rows"), F.count_if(bad).alias("malformed_rows")).select(
                F.lit(table).alias("source"), "rows", "malformed_rows"
            )
        )
    return union_all(counts)


def read_all_csv(spark: SparkSession, folder: str, files: Mapping[str, str] = CSV_FILES):
    return {table: read_raw_csv(spark, folder, table, files) for table in RAW}


def register_views(tables: Mapping[str, DataFrame]) -> None:
    """Expose tables to SQL under their own names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


# a bucket of this many bytes that is also this many times the average holds a hot key
HOT_BYTES, HOT_TIMES = 64_000_000, 4


def write_table(
    df: DataFrame,
    path: str,
    partition_by: str | None = None,
    observation: Observation | None = None,
    metrics: Sequence[Column] = (),
    lookup_by: str | None = None,
    bucket_by: str | None = None,
    balanced: bool = False,
) -> DataFrame:
    """Replace a table and return it as read back.

    With a partition column the rows are rebalanced first, unless the plan did so itself: AQE merges small partitions and
    splits large ones, so neither tiny files nor one huge task result from a hot value.
    Metrics are aggregates over the rows that the write itself takes for the observation; they
    come last, in the stage that writes, where a task that is run again counts once.
    With a lookup column the rows are sorted by it within every file and the column gets Bloom
    filters, so that a search for single values skips row groups by either.
    With a bucket column the rows of a key are in one file, one per shuffle partition, so that joins
    and aggregations by it need no shuffle. A table with a hot bucket is read back without buckets;
    its joins are shuffled and split by AQE.
    """
    writer = df
    if bucket_by:
        buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        writer = df.repartition(buckets, bucket_by)
    if partition_by and not balanced:
        writer = df.hint("rebalance", partition_by)
    if lookup_by:
        writer = writer.sortWithinPartitions(*filter(None, (partition_by, lookup_by)))
    if metrics:
        writer = writer.observe(observation, *metrics)
    writer = writer.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if lookup_by:
        writer = writer.option(f"parquet.bloom.filter.enabled#{lookup_by}", True)
    if bucket_by:
        name = f"buckets_{uuid.uuid4().hex}"
        writer.bucketBy(buckets, bucket_by).option("path", path).format("parquet").saveAsTable(name)
        if not _has_hot_file(df.sparkSession, path, buckets):
            return df.sparkSession.table(name)
    else:
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _has_hot_file(spark: SparkSession, path: str, buckets: int) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    sizes = [f.getLen() for f in files]
    return max(sizes) > max(HOT_BYTES, HOT_TIMES * sum(sizes) / buckets)


def append_table(df: DataFrame, path: str) -> None:
    """Add rows to a table in one job, committed as a whole."""
    df.write.mode("append").parquet(path)


def list_tables(spark: SparkSession, database: str = "default") -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(database))
