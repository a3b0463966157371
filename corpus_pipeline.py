"""A corpus pipeline: toxicity, near-duplicates, benchmark passages, secrets, packing.

Every stage takes (spark, docs, sf_dir), works on all documents that the stage before kept,
and returns documents with the columns they came with; the last one returns their pieces
with the sequences they are packed into. A table without rows passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazarlytics.llm import decontaminate, packing, secrets, simhash, toxicity
from bazarlytics.llm.common import fresh, prepared
from bazarlytics.llm.tokens import default_path
from bazarlytics.session import scratch_path

TOXIC_FROM = 0.7


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier, fitted on the given labels, finds toxic."""
    labels = prepared(spark).read.parquet(f"{sf_dir}/labels.parquet")
    score = fresh("toxicity", docs.columns)
    scored = toxicity.score(docs, toxicity.fit(docs, labels), score)
    return scored.where(F.col(score) < TOXIC_FROM).drop(score)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of every group whose fingerprints link."""
    prepared(spark)
    return simhash.deduplicate(docs, size=4, threshold=4)


def remove_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    benchmark = prepared(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, benchmark)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts by a mask; every document stays."""
    prepared(spark)
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id and offset of every piece."""
    prepared(spark)
    return packing.place(packing.pieces(docs, default_path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_benchmark_passages),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet and read again."""
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Trained scores and the latent space are not expressible in SQL.
ORACLE_SQL = None
