"""Parallelism guard for CPU-heavy stages over few input splits."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, min_partitions: int | None = None, by: str | None = None) -> DataFrame:
    """Round-robin repartition only when the input has fewer partitions than
    the cluster can run at once (e.g. one large parquet row group).

    On large inputs the scan already yields many splits and this is a no-op,
    so no shuffle is added where it is not needed. Meant for scan outputs:
    their partition count is known at planning time without running a job.

    With ``by``, rows go by that column instead, into as many partitions, whatever
    their size: a grouping by it follows without a further shuffle.
    """
    spark = df.sparkSession
    target = min_partitions or max(spark.sparkContext.defaultParallelism,
                                   int(spark.conf.get("spark.sql.shuffle.partitions")))
    if by is not None:
        return df.repartition(target, by)
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target)
