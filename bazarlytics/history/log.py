"""A log of runs that several writers share and whose two tables always fit together.

A part is a folder with both tables. It is written aside and then renamed into place, so a
reader sees a run with all its model executions or not at all, and writers never meet, since
every part has a name of its own. Compaction writes the visible rows as one more part; every
logged entry is read from the last part, by name, that holds it, so neither a second compaction
nor one that broke off repeats or loses a run. Renaming a folder is atomic on HDFS and on local
disks; on an object store the log needs a committer that makes it so.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazarlytics.history.runs import MODEL_TABLE, RUN_TABLE, model_executions, run_summary
from bazarlytics.sources.artifacts import read_manifest, read_run_results
from bazarlytics.sources.files import empty_table
from bazarlytics.sources.schemas import MODEL_HISTORY, RUN_HISTORY

SCHEMAS = {RUN_TABLE: RUN_HISTORY, MODEL_TABLE: MODEL_HISTORY}
ENTRY, PART = "log_entry", "log_part"


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def parts(spark: SparkSession, folder: str) -> list[str]:
    """Names of the parts in place; those of later compactions sort last."""
    system, place = _file_system(spark, f"{folder}/parts")
    if not system.exists(place):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(place))


def _publish(tables: dict[str, DataFrame], folder: str, part: str) -> None:
    spark = tables[RUN_TABLE].sparkSession
    for name, df in tables.items():
        # small files merge into few, and a large part stays many
        df.withColumn(PART, F.lit(part)).hint("rebalance").write.parquet(f"{folder}/staged/{part}/{name}")
    system, place = _file_system(spark, f"{folder}/parts")
    system.mkdirs(place)
    staged, final = (_file_system(spark, f"{folder}/{state}/{part}")[1] for state in ("staged", "parts"))
    if not system.rename(staged, final):
        raise OSError(f"part {part} could not be put in place")


def log_rows(runs: DataFrame, models: DataFrame, folder: str) -> str:
    """Log runs with their model executions as one entry and return its name."""
    entry = f"000000-{uuid.uuid4().hex}"
    tables = {RUN_TABLE: runs, MODEL_TABLE: models}
    _publish({name: df.select(*SCHEMAS[name].names).withColumn(ENTRY, F.lit(entry)) for name, df in tables.items()}, folder, entry)
    return entry


def log_artifacts(spark: SparkSession, run_path: str, manifest_path: str, folder: str) -> str:
    """Log the run that the two artifact files describe."""
    results = read_run_results(spark, run_path)
    return log_rows(run_summary(results), model_executions(results, read_manifest(spark, manifest_path)), folder)


def _visible(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Rows of the given parts, every entry from the last part that holds it."""
    rows = {}
    for name, schema in SCHEMAS.items():
        whole = T.StructType(list(schema.fields)).add(ENTRY, "string").add(PART, "string")
        paths = [f"{folder}/parts/{part}/{name}" for part in names]
        rows[name] = spark.read.schema(whole).parquet(*paths) if paths else empty_table(spark, whole)
    owner = rows[RUN_TABLE].groupBy(ENTRY).agg(F.max(PART).alias(PART))
    return {name: df.join(owner, [ENTRY, PART], "left_semi") for name, df in rows.items()}


def read_log(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The runs and the model executions of one state of the log; an empty log has no rows.

    Executions logged without any run are not seen.
    """
    tables = _visible(spark, folder, parts(spark, folder))
    return tuple(tables[name].select(*schema.names) for name, schema in SCHEMAS.items())


def compact(spark: SparkSession, folder: str) -> str | None:
    """Write all visible rows as one part and return its name; fewer than two parts stay as they are.

    The parts before it stay until release() and cost readers their scan until then.
    """
    names = parts(spark, folder)
    if len(names) < 2:
        return None
    level = max(int(name.split("-")[0]) for name in names) + 1
    part = f"{level:06d}-{uuid.uuid4().hex}"
    _publish({name: df.drop(PART) for name, df in _visible(spark, folder, names).items()}, folder, part)
    return part


def release(spark: SparkSession, folder: str) -> list[str]:
    """Delete the parts of which no entry is read any more and return their names.

    Call it when no reader of an earlier state is under way; later readers never need them.
    """
    names = parts(spark, folder)
    if not names:
        return []
    owners = _visible(spark, folder, names)[RUN_TABLE].select(PART).distinct()
    used = {row[PART] for row in owners.collect()}  # at most one row per part
    unused = [name for name in names if name not in used]
    for name in unused:
        system, place = _file_system(spark, f"{folder}/parts/{name}")
        system.delete(place, True)
    return unused
