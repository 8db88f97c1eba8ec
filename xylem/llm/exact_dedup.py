"""Exact dedup by distributed most-significant-digit radix partitioning.

Every text is its normalised UTF-8 bytes. A digit is a run of successive bytes; round r deals the groups that are still open
by their next digit, and the digit grows sixteenfold each round, so that any length is ended in a few rounds. A group of one
is settled; a group whose digit was cut short by the end of the text has ended, and its rows are equal byte for byte: no
digest decides equality. Groups are counted with partial aggregation; rows meet their group's count in a shuffled
join that adaptive execution can split when one group holds a large part of all rows. After the first round only rows of
open groups go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from xylem.llm.text import SPACE
from xylem.session import Workspace

#: Bytes of the first digit, and by what it grows each round.
FIRST_DIGIT, GROWTH = 48, 16


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, first_digit: int = FIRST_DIGIT) -> DataFrame:
    """``docs`` without ``text_col``, with a struct ``_dedup`` (keep_id, group_size, kept, text_sha256, text); one row per input row.

    Null text counts as empty; empty texts are equal. Null ids sort last. Of rows that repeat both id and text, one is kept:
    the first by the hash of their other columns. Other columns pass through; ``_dedup`` must not be among them. ``text`` in
    the struct is the original text of kept rows and null elsewhere (without ``keep_text``, null everywhere, which saves
    writing texts that stand alone). An empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "exact-dedup")
    rest = [c for c in docs.columns if c != text_col]
    norm = normalised(F.col(text_col))
    rows = docs.select(F.struct(*rest).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.unhex(F.sha2(norm, 256)).alias("sha"), F.lit(0).cast("long").alias("gid"))
    settled, at, width = [], 0, first_digit
    while True:
        digit = F.substring(F.encode(normalised(F.col("text")), "UTF-8"), at + 1, width)
        dealt = rows.withColumn("digit", digit)
        groups = dealt.groupBy("gid", "digit").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("keep")).where("n > 1")
        groups = work.save(groups.withColumn("next", F.monotonically_increasing_id()), f"groups{at}")
        # the same plan at any size: a sort-merge join, whose hot partitions adaptive execution splits
        joined = dealt.join(groups.hint("merge"), ["gid", "digit"], "left")
        open_ = F.col("n").isNotNull() & (F.length("digit") == width)
        text = F.col("text") if keep_text else F.when(open_, F.col("text"))
        state = work.save(joined.select("row", "id", text.alias("text"), "sha", "n", "keep", "next", open_.alias("open")), f"round{at}")
        work.drop(groups)
        settled.append(alone(state.where("n IS NULL")))
        same = Window.partitionBy("next", "id").orderBy(F.xxhash64("row"))
        ended = state.where("n IS NOT NULL AND NOT open").withColumn("nth", F.row_number().over(same))
        settled.append(result(ended, F.col("keep"), F.col("n"), F.col("id").eqNullSafe(F.col("keep")) & (F.col("nth") == 1)))
        rows = state.where("open").select("row", "id", "text", "sha", F.col("next").alias("gid"))
        at, width = at + width, width * GROWTH
        if not rows.head(1):
            break
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    return out.select("row.*", F.struct("keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), F.when(F.col("kept"), F.col("text")).alias("text")).alias("_dedup"))


def alone(rows: DataFrame) -> DataFrame:
    return result(rows, F.col("id"), F.lit(1).cast("long"), F.lit(True))


def result(rows: DataFrame, keep, size, kept) -> DataFrame:
    return rows.select("row", "text", "sha", keep.alias("keep_id"), size.alias("group_size"), kept.alias("kept"))


def verdicts(docs: DataFrame) -> DataFrame:
    """The contract's columns for ``documents``."""
    out = exact_dedup(docs.select("doc_id", "text"), keep_text=False)
    return out.select("doc_id", "_dedup.keep_id", "_dedup.group_size", "_dedup.kept", "_dedup.text_sha256")


def kept_documents(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each text, with all columns of ``docs``."""
    out = exact_dedup(docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "doc_id", "text")).where("_dedup.kept")
    return out.select("row.*", F.col("_dedup.text").alias("text")).select(*[F.col(f"`{c}`") for c in docs.columns])
