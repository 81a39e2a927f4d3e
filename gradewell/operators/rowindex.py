"""Distributed row numbering and prefix sums without one-task windows.

``row_number() over (partition by s order by k)`` puts a whole stratum on one
task; a stratum holding a third of all rows then sorts a third of the data in
one task. Here every row also carries an order-compatible *bucket* (a coarse
function of the leading order key, e.g. the first hex digits of an md5 key or
the hour of a timestamp): all rows of bucket b sort before those of bucket
b+1. Rows are numbered inside (strata, bucket) windows, and a small table of
per-bucket counts supplies each bucket's offset. Everything is a
deterministic function of the data, so retried tasks recompute the same
numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hex_bucket(hex_col: str | Column, digits: int = 3) -> Column:
    """Bucket from the leading hex digits of an md5 key (16^digits uniform buckets)."""
    c = F.col(hex_col) if isinstance(hex_col, str) else hex_col
    return F.conv(F.substring(c, 1, digits), 16, 10).cast("int")


BUCKET_ROWS = 65_536     # rows that one window sorts
MAX_BUCKETS = 10_000     # bounds that the driver holds


def range_bucket(df: DataFrame, key: str, name: str) -> DataFrame:
    """Add ``name``: the quantile range of a numeric ``key``, about ``BUCKET_ROWS`` rows each.

    The bounds come from the rows themselves (one count and, for more than one
    bucket, one quantile sketch, both eager), so dense, sparse and clustered
    ids give ranges of like size. A NULL key has a NULL range.
    """
    n = min(MAX_BUCKETS, -(-df.count() // BUCKET_ROWS))
    if n <= 1:
        return df.withColumn(name, F.when(F.col(key).isNotNull(), F.lit(0.0)))
    number = f"{name}_key"
    keyed = df.withColumn(number, F.col(key).cast("double"))
    inner = keyed.approxQuantile(number, [i / n for i in range(1, n)], 0.25 / n)
    bounds = [float("-inf"), *sorted(set(inner)), float("inf")]
    ranged = Bucketizer(splits=bounds, inputCol=number, outputCol=name, handleInvalid="keep").transform(keyed)
    return ranged.withColumn(name, F.when(F.col(key).isNotNull(), F.col(name))).drop(number)


def global_row_index(df: DataFrame, order: Sequence, strata: Sequence[str] = (),
                     bucket: Column | None = None, name: str = "rn") -> DataFrame:
    """Add a 1-based ``name`` column numbering rows by ``order`` within ``strata``.

    Equivalent to ``row_number() over (partition by strata order by order)``.
    ``order`` items are column names or sort expressions and must form a unique
    key. ``bucket`` must be non-decreasing in ``order`` (rows with equal bucket
    are contiguous in the order); without it the stratum is one bucket.
    """
    b = bucket if bucket is not None else F.lit(0)
    sort_keys = [F.col(o).asc() if isinstance(o, str) else o for o in order]
    with_b = df.withColumn("_gw_b", b)
    counts = with_b.groupBy(*strata, "_gw_b").agg(F.count(F.lit(1)).alias("_gw_n"))
    before = Window.partitionBy(*strata).orderBy("_gw_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(s).alias(f"_gw_s_{s}") for s in strata],
                            F.col("_gw_b").alias("_gw_b_r"),
                            F.coalesce(F.sum("_gw_n").over(before), F.lit(0)).alias("_gw_before"))
    if not strata:
        offsets = F.broadcast(offsets)                        # a row for each bucket: the rows stay where they are
    cond = with_b["_gw_b"].eqNullSafe(offsets["_gw_b_r"])     # rows without an order key share a bucket
    for s in strata:
        cond = cond & with_b[s].eqNullSafe(offsets[f"_gw_s_{s}"])
    joined = with_b.join(offsets, cond, "inner")
    inner = Window.partitionBy(*strata, "_gw_b").orderBy(*sort_keys)
    rn = F.col("_gw_before") + F.row_number().over(inner)
    return joined.withColumn(name, rn.cast("long")).drop(
        "_gw_b", "_gw_b_r", "_gw_before", *[f"_gw_s_{s}" for s in strata])


def bucketed_running(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: str,
                     aggs: dict[str, tuple], inclusive: bool = True) -> DataFrame:
    """Running aggregates per ``keys`` in ``order`` without a one-task window per key.

    ``bucket`` is a coarse, order-compatible column (e.g. an hour of a
    timestamp): every row of bucket b precedes every row of bucket b+1. Step 1
    aggregates per (keys, bucket) map-side; step 2 takes exclusive prefix
    aggregates over that small table; step 3 windows only inside each
    (keys, bucket) and combines with the prefix. ``aggs`` maps an output name to
    (function, input column or expression) with function in sum/min/max;
    min/max also work on structs (e.g. the running argmin as min(struct(v, k))).
    """
    fn = {"sum": F.sum, "min": F.min, "max": F.max}
    # least/greatest skip NULLs, so an empty prefix or empty local frame is neutral.
    comb = {"sum": lambda a, b: F.coalesce(a + b, a, b),
            "min": F.least, "max": F.greatest}
    per_bucket = df.groupBy(*keys, bucket).agg(
        *[fn[f](c).alias(f"_br_{out}") for out, (f, c) in aggs.items()])
    prev = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    prefix = per_bucket.select(
        *keys, bucket, *[fn[f](f"_br_{out}").over(prev).alias(f"_bp_{out}")
                         for out, (f, c) in aggs.items()])
    frame_end = 0 if inclusive else -1
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, frame_end)
    # NULL keys and buckets are groups like any other
    own = [*keys, bucket]
    prefix = prefix.select(*[F.col(c).alias(f"_bk_{c}") for c in own], *[f"_bp_{out}" for out in aggs])
    cond = reduce(lambda a, b: a & b, [df[c].eqNullSafe(prefix[f"_bk_{c}"]) for c in own])
    if not keys:
        prefix = F.broadcast(prefix)                          # a row for each bucket
    joined = df.join(prefix, cond, "left")
    cols = [comb[f](F.col(f"_bp_{out}"), fn[f](c).over(inner)).alias(out)
            for out, (f, c) in aggs.items()]
    return joined.select(*df.columns, *cols)


def ordered_row_index(df: DataFrame, lead: str, rest: Sequence, bucket: Column,
                      descending: bool = False, name: str = "rn") -> DataFrame:
    """``row_number() over (order by lead [desc], rest…)`` for a whole table.

    Two levels, so no window sees more than one lead value's buckets: rows are
    numbered inside each lead value (the lead is the stratum, ``bucket`` splits
    a hot value), and each lead value's offset is a prefix sum over the table
    of distinct lead values (e.g. token lengths or frequencies), which is far
    smaller than the data.
    """
    inner = global_row_index(df, rest, strata=[lead], bucket=bucket, name="_or_in")
    order = F.col(lead).desc() if descending else F.col(lead).asc()
    per_lead = df.groupBy(lead).agg(F.count(F.lit(1)).alias("_or_n"))
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_lead.select(F.col(lead).alias("_or_lead"),
                              F.coalesce(F.sum("_or_n").over(before), F.lit(0)).alias("_or_off"))
    # a row for each lead value, which one task has sorted: the rows stay where they are
    joined = inner.join(F.broadcast(offsets), inner[lead].eqNullSafe(offsets["_or_lead"]), "inner")
    return joined.withColumn(name, (F.col("_or_off") + F.col("_or_in")).cast("long")) \
        .drop("_or_in", "_or_lead", "_or_off")
