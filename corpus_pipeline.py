"""The corpus pipeline: documents in, packed training bins out.

Quality first, as it is cheapest by row and spares the rest what it rejects; then exact copies, near
copies, documents that hold benchmark passages, and the packing of what remains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thema.llm.decontam import drop_contaminated
from thema.llm.exact_dedup import drop_exact_duplicates
from thema.llm.near_dedup import drop_near_duplicates
from thema.llm.packing import pack_documents
from thema.llm.quality import keep_good
from thema.storage import drop, scratch, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model calls good stay."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with the same bytes stays."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a long span with a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's parts with their bins."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Training, search trees and packing aren't expressible in SQL; the tests hold every stage and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next. What a stage wrote for itself goes when its result is there,
    and that when the next one's is; only what the result reads is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before = docs
        with scratch(spark) as s:
            docs = s.keep(written(stage(spark, before, sf_dir)))
        drop(before)
    out = STAGES[-1][1](spark, docs, sf_dir)
    drop(docs)  # packing has the lengths in a table of its own
    return out
