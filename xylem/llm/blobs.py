"""Binary files through Spark's own writer and reader: committed once per task on any file system, also when an executor is lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_blobs(df: DataFrame, path: str, column: str = "blob", after: str = "\n") -> None:
    """One file per partition: its rows' bytes, each followed by ``after`` (Latin-1 text for its bytes)."""
    df.select(F.col(column).cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", after).text(path)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "content")
