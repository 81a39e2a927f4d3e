"""Ordered fragment merge, id overlap and the unlabelled pool.

The merge is two-level: fragments are first merged inside order chunks of
``chunk`` fragments per id (spread over many tasks, so an id holding a third
of all rows is split), then the chunk strings of an id are joined in chunk
order. Newline/BEL blanking is per character and space collapsing is
idempotent across the join, so the result equals a one-level merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.functions.text import clean_merged


def _ordered_join(struct_col, sep: str = " "):
    return F.array_join(F.transform(F.array_sort(struct_col), lambda s: s["t"]), sep)


def merge_fragments(frags: DataFrame, id_col: str = "id", ord_col: str = "ord",
                    text_col: str = "text", chunk: int = 4096) -> DataFrame:
    """``(id, merged_text, n_fragments)``: texts joined by a space in order, cleaned."""
    chunked = frags.select(id_col, F.col(ord_col).alias("o"), F.col(text_col).alias("t"),
                           F.floor(F.col(ord_col) / F.lit(chunk)).alias("_chunk"))
    level1 = chunked.groupBy(id_col, "_chunk").agg(
        clean_merged(_ordered_join(F.collect_list(F.struct("o", "t")))).alias("t"),
        F.count(F.lit(1)).alias("_n"))
    level2 = level1.groupBy(id_col).agg(
        clean_merged(_ordered_join(F.collect_list(F.struct(F.col("_chunk").alias("o"), "t"))))
        .alias("merged_text"),
        F.sum("_n").alias("n_fragments"))
    return level2


def overlap(left_ids: DataFrame, right_ids: DataFrame, key: str = "id") -> DataFrame:
    """One row: distinct ids in both sets, rows of the right set, and their ratio.

    ``right_ids`` plays the labelled table: its row count is the denominator. Without
    a row there the ratio is NULL.
    """
    left_d = left_ids.select(F.col(key).alias("_k")).distinct().withColumn("_hit", F.lit(1))
    j = right_ids.select(F.col(key).alias("_k")).join(left_d, "_k", "left")
    return j.agg(F.countDistinct(F.when(F.col("_hit") == 1, F.col("_k"))).alias("n_common"),
                 F.count(F.lit(1)).alias("n_labelled")) \
        .withColumn("ratio", F.try_divide(F.col("n_common"), F.col("n_labelled")))


def unlabelled_pool(merged: DataFrame, labelled: DataFrame, id_col: str = "id",
                    labelled_id: str = "text_id") -> DataFrame:
    """Merged texts whose id is not labelled, renamed to ``(text_id, full_text)``."""
    lab = labelled.select(F.col(labelled_id).alias(id_col))
    return merged.join(lab, id_col, "left_anti").select(
        F.col(id_col).alias("text_id"), F.col("merged_text").alias("full_text"))
