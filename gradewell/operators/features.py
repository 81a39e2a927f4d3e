"""Feature-store shaping: horizontal concatenation of encoder blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hconcat(blocks: DataFrame, key: str, n_blocks: int, block_col: str = "block",
            vec_col: str = "vec") -> DataFrame:
    """``(key, block, vec)`` rows → ``(key, vec)`` with blocks concatenated in block order.

    One row per (key, block) is gathered per key, so the group size is the
    number of encoders, not the data size. A key with a missing block fails
    the query instead of silently producing a shorter vector.
    """
    g = blocks.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(block_col).alias("b"), F.col(vec_col).alias("v"))))
        .alias("_bs"))
    vec = F.flatten(F.transform("_bs", lambda s: s["v"]))
    checked = F.when(F.size("_bs") == F.lit(n_blocks), vec).otherwise(
        F.raise_error(F.concat(F.lit("feature block count mismatch for key "),
                               F.col(key).cast("string"))))
    return g.select(key, checked.alias("vec"))
