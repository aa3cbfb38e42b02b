"""Exact duplicates by content sort.

Rows are range-partitioned by their normalised text with splitters that Spark samples, and sorted there (externally,
spilling where needed), so equal texts lie next to each other.  Every row is compared in full with its neighbours; each
run of equal texts keeps its smallest id.  A text that makes up a large part of all rows is split by a second sort key,
a slot of the id; the heads of its slots (at most ``SLOTS`` rows a text) are put together afterwards.

Native: only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import SPACES, saved

#: A text of any number of copies is spread over this many sort ranges.
SLOTS = 64
#: Characters of a text in the sampled splitters, which pass the driver; the sort itself compares whole texts.
HEAD = 64


def normalised(text: Column) -> Column:
    """Null becomes empty; each run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Equal texts are those whose ``normalised`` forms are identical byte by byte.  ``keep_id`` is the smallest id of the
    group; ids that are null rank last, and a group of nulls alone has keep_id null.  Of rows that repeat text and id
    exactly one is kept.  An empty table gives an empty result.  Other columns do not matter and are not returned.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), normalised(F.col(f"`{text_col}`")).alias("_norm"))
    rows = rows.withColumn("_slot", F.pmod(F.xxhash64("_id"), F.lit(slots)).cast("int"))
    rows = rows.withColumn("_head", F.substring("_norm", 1, HEAD))
    # one exchange of the texts: the window below is satisfied by this range partitioning and only sorts inside it
    laid = rows.repartitionByRange(F.col("_head"), F.col("_slot"))
    run = Window.partitionBy("_head", "_slot", "_norm").orderBy(F.col("_id").asc_nulls_last())
    heads_of = laid.withColumn("_at", F.row_number().over(run))
    # the text stays behind here; what goes on is its digest, written because it is read twice
    narrow = saved(heads_of.select("_id", "_slot", "_at", F.sha2(F.col("_norm"), 256).alias("_sha"),
                                   F.length("_norm").alias("_len")), "dedup-digests")
    part = ["_sha", "_len", "_slot"]
    slot_heads = narrow.groupBy(*part).agg(F.min("_id").alias("_keep"), F.max("_at").cast("long").alias("_n"))
    text = Window.partitionBy("_sha", "_len")
    first = text.orderBy(F.col("_keep").asc_nulls_last(), F.col("_slot"))
    merged = slot_heads.select(
        *part, F.min("_keep").over(text).alias("keep_id"), F.sum("_n").over(text).alias("group_size"),
        (F.row_number().over(first) == 1).alias("_first"))
    return narrow.join(merged, part).select(
        F.col("_id").alias(id_col), "keep_id", "group_size", (F.col("_first") & (F.col("_at") == 1)).alias("kept"),
        F.col("_sha").alias("text_sha256"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without later copies; all columns stay.  Of rows equal in text and id one is kept."""
    keep = exact_groups(docs, id_col, text_col).where("kept").select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.col("text_sha256").alias("_sha"))
    marked = docs.withColumns({"_id": F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")),
                               "_sha": F.sha2(normalised(F.col(f"`{text_col}`")), 256)})
    # a kept id names one text; rows that repeat both are cut down to one, in the join's own partitions
    same = Window.partitionBy("_id", "_sha").orderBy(F.lit(0))
    out = marked.join(keep, ["_id", "_sha"]).withColumn("_at", F.row_number().over(same)).where("_at = 1")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
