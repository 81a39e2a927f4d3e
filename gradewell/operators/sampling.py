"""Seeded shuffles, deterministic samples and column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.operators.rowindex import global_row_index, hex_bucket


def seeded_shuffle(df: DataFrame, id_col: str, seed: int, epochs: int = 1) -> DataFrame:
    """``(epoch, id, pos)``: a different deterministic order per epoch.

    The order key is ``md5('<seed>:<epoch>:<id>')``; positions are numbered
    with the distributed row index, one stratum per epoch.
    """
    rep = df.select(id_col).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    keyed = rep.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"),
                                                   F.col(id_col).cast("string"))))
    out = global_row_index(keyed, ["_h", id_col], strata=["epoch"], bucket=hex_bucket("_h"),
                           name="pos")
    return out.select("epoch", id_col, "pos")


def sample_n(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """Deterministic sample of ``n`` rows: smallest md5(seed:id). The limit is the
    feature; Spark plans it as a per-partition top-n plus a merge."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return df.orderBy(key, F.col(id_col)).limit(n)


def profile(df: DataFrame) -> DataFrame:
    """One-pass profile of the documents table."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.count(F.lit(1)) - F.count("text")).alias("n_null_text"),
        # exact distinct over 16-byte md5 digests: the shuffle carries digests,
        # not document bodies (a collision needs ~2^64 distinct texts)
        F.countDistinct(F.unhex(F.md5("text"))).alias("n_distinct_text"),
        F.countDistinct("lang").alias("n_distinct_lang"),
        F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"),
        F.round(F.avg("n_chars"), 6).alias("avg_chars"))
