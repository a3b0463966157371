"""Storage and schema helpers shared by the operators."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazarlytics.session import RUNTIME_CONF, scratch_path


#: Rows that a worker gets at once; documents may be long.
WORKER_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
_shipped: set[str] = set()


def prepared(spark: SparkSession) -> SparkSession:
    """Set what the operators rely on: UTC, adaptive plans, split skewed joins, and this package
    on the workers' path."""
    for key, value in (RUNTIME_CONF | WORKER_CONF).items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    app, root = spark.sparkContext.applicationId, Path(__file__).resolve().parents[2]
    if app not in _shipped and str(root) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/bazarlytics", "zip", root, "bazarlytics")
        spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
    return spark


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a row id of their own, stored so that it stays, and its column's name."""
    row = fresh("_row", docs.columns)
    return store(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-rows"), row


def fresh(name: str, taken: list[str]) -> str:
    """The name, with underscores after it until no column has it; names ignore case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def crc32_mod(column: Column, modulus: int) -> Column:
    """The unsigned CRC-32 of a value's text, modulo a number."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row. As a generated column it is not copied into
    later expressions, where a copy inside a lambda would be computed for every element."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c != name), F.explode(F.array(value)).alias(name))


def utf8(text: Column) -> Column:
    """Text as bytes; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose lengths add up to at most `most`, or hold a single row."""
    first, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > first and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(lengths):
        yield first, len(lengths)


def batch(**columns) -> pa.RecordBatch:
    """An Arrow batch from arrays in the order given."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns)
    )
