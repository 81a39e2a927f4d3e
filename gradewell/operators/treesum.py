"""Block-wise sums of per-partition partial arrays (a DataFrame tree aggregate).

Operators that reduce each input partition to dense partials (Gram
matrices, gradients) emit them as fixed-size blocks ``(keys, name, block,
values)``. Blocks are summed per (keys, name, block): the reduce is spread
over as many tasks as there are blocks and each aggregation buffer holds one
block, not a whole d x d matrix. With many partials the sum runs in two
levels (groups of ~sqrt(P) partitions first). The driver, which consumes
the totals, re-assembles the summed blocks in block order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096              # values per block
SINGLE_LEVEL_MAX = 64     # partials per block that one reduce task sums directly
BLOCK_SCHEMA = "_name string, _blk int, _v array<double>, _part int"


def partition_id() -> int:
    """Id of the running task's partition (inside mapInPandas functions)."""
    from pyspark import TaskContext

    ctx = TaskContext.get()
    return ctx.partitionId() if ctx is not None else 0


def blocks(arrays: dict[str, np.ndarray], keys: dict | None = None) -> list[dict]:
    """Rows for one partial: every array cut into ``BLOCK``-sized pieces."""
    part = partition_id()
    rows = []
    for name, arr in arrays.items():
        flat = np.asarray(arr, dtype=np.float64).ravel()
        for b in range(max(1, math.ceil(flat.size / BLOCK))):
            rows.append({**(keys or {}), "_name": name, "_blk": b,
                         "_v": flat[b * BLOCK:(b + 1) * BLOCK].tolist(), "_part": part})
    return rows


def block_sum(parts: DataFrame, keys: Sequence[str],
              max_names: Sequence[str] = (), n_partials: int | None = None) -> DataFrame:
    """Sum (or, for ``max_names``, take the element-wise max of) the block rows
    per (keys, name, block); returns ``(keys…, _name, _blk, _v)``."""
    spark = parts.sparkSession
    # the number of partials is about the cluster's parallelism; asking the
    # plan for its partition count could execute adaptive stages early
    p = n_partials or max(spark.sparkContext.defaultParallelism,
                          int(spark.conf.get("spark.sql.shuffle.partitions")))
    is_max = F.col("_name").isin(list(max_names)) if max_names else None
    vector = array_to_vector("_v")

    def agg(total, top):
        # the element-wise max is only worked out where a name asks for it
        return [Summarizer.sum(total).alias("_s"), *([Summarizer.max(top).alias("_m")] if max_names else [])]

    grp = [*keys, "_name", "_blk"]
    if p <= SINGLE_LEVEL_MAX:
        summed = parts.groupBy(*grp).agg(*agg(vector, vector))
    else:
        fan = max(1, int(math.ceil(math.sqrt(p))))
        lvl1 = parts.groupBy(*grp, F.pmod(F.col("_part"), F.lit(fan)).alias("_g")).agg(*agg(vector, vector))
        summed = lvl1.groupBy(*grp).agg(*agg(F.col("_s"), F.col("_m") if max_names else None))
    vals = vector_to_array("_s")
    if max_names:
        vals = F.when(is_max, vector_to_array("_m")).otherwise(vals)
    return summed.select(*grp, vals.alias("_v"))


def collect_blocks(summed: DataFrame, keys: Sequence[str]) -> dict[tuple, dict[str, np.ndarray]]:
    """Bring summed blocks to the driver (the consumer there needs the whole
    matrices anyway) and re-assemble ``{key tuple: {name: flat array}}``."""
    pieces: dict[tuple, dict[str, list]] = {}
    for r in summed.collect():
        k = tuple(r[c] for c in keys)
        pieces.setdefault(k, {}).setdefault(r["_name"], []).append((r["_blk"], r["_v"]))
    return {k: {n: np.concatenate([np.asarray(v, dtype=np.float64) for _, v in sorted(bl)])
                for n, bl in by_name.items()} for k, by_name in pieces.items()}
