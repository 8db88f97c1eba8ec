"""Documents as files: one file a document, written through Spark's own sink and so committed per task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_xml(docs: DataFrame, path: str, encoding: str = "UTF-8", id_col: str = "doc_id", xml_col: str = "xml") -> None:
    """Write (id, xml) as ``path/id=.../part-*.txt``, each ending in a line feed. Null xml is an empty document."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(xml_col), F.lit("")).alias("value"))
    rows.write.option("encoding", encoding).partitionBy("id").text(path)


def load_xml(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(doc_id, xml) of what save_xml() wrote; ids as their text reads."""
    return spark.read.option("encoding", encoding).text(path, wholetext=True).select(F.col("id").alias("doc_id"), F.rtrim(F.col("value"), F.lit("\n")).alias("xml"))
