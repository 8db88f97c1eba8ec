"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing and packing, each on what the stage before kept.

Every stage but the last returns the columns of documents, and its decisions are carried out: rejected documents and copies are
gone, mixed ones are there as often as they are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from xylem.llm import exact_dedup, mixing, near_dedup, packing, quality
from xylem.session import Workspace


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base limits or lie far out in their language and source go. Null text has no words and goes; so does an empty one."""
    return quality.kept_documents(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that differ in white space at most, one row stays, that with the smallest doc_id (null last)."""
    return exact_dedup.kept_documents(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by shingles of five words and a similarity of 0.8 or more, one stays; documents without words all do."""
    return near_dedup.kept_documents(docs, near_dedup.FIVE_WORDS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of sources takes it: not at all, once or twice. Documents without words go."""
    return mixing.mixed_documents(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of each row, with its place in a sequence of at most 4096 tokens. An empty table gives no rows, as in every stage."""
    return packing.packed(docs)


STAGES = [("quality rules", quality_stage), ("exact dedup", exact_stage), ("near-dedup", near_stage), ("mixing", mix_stage), ("packing", pack_stage)]

#: The MCD estimate, genetic packing and random rounding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
