"""Training-log analytics as streaming state: meters, best values and early stops of a
metric stream whose files come in any order (D7, E4, E5, E7, L1).

The state is kept for each (run, hour): the hour's rows in their order, which is bounded
by what a run logs in an hour, however long the run is. Whenever rows arrive, the
operator gives the hour's summary anew: how many updates, their sums, and the values that
improve on all before them within the hour. Such summaries lose nothing that a meter, a
best value or an early stop needs: an improvement of the whole run is one of its hour's,
and steps are counted by hours. The latest summary of each hour is put together by a short
batch over them, so an early row that comes late changes every step after it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradewell.session import scratch_path
from gradewell.sources import committed

SUMMARY = ("run long, hour timestamp, n_updates long, val_n double, n double, val double, n_val long, "
           "offsets array<long>, values array<double>")


def improvements(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values that are less than all known ones before; NaN is not known."""
    known = np.where(np.isnan(values), np.inf, values)
    before = np.concatenate([[np.inf], np.minimum.accumulate(known)[:-1]]) if len(known) else known
    at = np.flatnonzero(known < before)
    return at, known[at]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The summary of each hour from its rows, put in order; many hours at a time."""
    kinds = {"ts": np.int64, "event_id": np.int64, "val": np.float64, "n": np.float64}
    for batch in batches:
        lists = batch.column("rows")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        held = {c: flat.field(c).to_numpy(zero_copy_only=False).astype(k) for c, k in kinds.items()}
        hour = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((held["n"], held["val"], held["event_id"], held["ts"], hour))
        val, n = held["val"][order], held["n"][order]
        known, both = ~np.isnan(val), ~np.isnan(val) & ~np.isnan(n)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        better = known & np.repeat(sizes == 1, sizes)
        for i in np.flatnonzero(sizes > 1):
            better[starts[i] + improvements(val[starts[i]:ends[i]])[0]] = True
        at = np.concatenate([[0], np.cumsum(np.bincount(hour[better], minlength=len(sizes)))]).astype(np.int32)
        total = lambda x: np.bincount(hour, x, len(sizes))
        lists_of = lambda x: pa.ListArray.from_arrays(pa.array(at), pa.array(x))
        yield pa.RecordBatch.from_arrays(
            [batch.column("run"), batch.column("hour"), pa.array(sizes), pa.array(total(np.where(both, val * n, 0.0))),
             pa.array(total(np.nan_to_num(n))), pa.array(total(np.nan_to_num(val))),
             pa.array(total(known).astype(np.int64)), lists_of((np.arange(len(val)) - starts[hour])[better]),
             lists_of(val[better])], [c.split()[0] for c in SUMMARY.split(", ")])


def hourly(stream: DataFrame) -> DataFrame:
    """Summaries of a metric stream ``(run, ts, event_id, val, n)`` by (run, hour), given
    again whenever the hour gets rows. Rows without a time have an hour of their own.

    Most hours have a row or a few, so the rows are kept by Spark's own aggregate, and the
    hours that a trigger changed are summarised a batch at a time, not one by one."""
    rows = stream.select(F.col("run").cast("long").alias("run"), F.date_trunc("hour", "ts").alias("hour"),
                         F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("ts"), F.coalesce("event_id", F.lit(0)).alias("event_id"),
                         F.col("val").cast("double").alias("val"), F.col("n").cast("double").alias("n"))
    held = rows.groupBy("run", "hour").agg(F.collect_list(F.struct("ts", "event_id", "val", "n")).alias("rows"))
    return held.mapInArrow(_summaries, SUMMARY)


def drain(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Run a metric stream over all that is there, a save of summaries for each trigger, and
    return the latest summary of each (run, hour)."""
    path, checkpoint = scratch_path(spark, "hours"), scratch_path(spark, "hours-ckpt")

    def put(batch: DataFrame, _: int) -> None:
        committed.save(batch, path)

    query = (hourly(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
             .foreachBatch(put).trigger(availableNow=True).start())
    query.awaitTermination()
    rows = committed.read(spark, path)
    if rows is None:                              # a stream without a row
        return spark.createDataFrame([], SUMMARY)
    return committed.latest(rows, ["run", "hour"]).drop("commit", "number")


def daily_meter(hours: DataFrame) -> DataFrame:
    """``(run, day, n_updates, avg)``: the meter's daily windows, from hours."""
    day = F.date_trunc("day", "hour").alias("day")
    sums = hours.groupBy("run", day).agg(F.sum("n_updates").alias("n_updates"), F.sum("val_n").alias("_vn"),
                                         F.sum("n").alias("_n"))
    return sums.select("run", "day", "n_updates", F.try_divide("_vn", "_n").alias("avg"))


def _run_improvements(hours: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(run, step, val)`` of each run's improvements, and ``(run, n_steps)``. Windows are
    over a run's hours, and over their few improvements."""
    before = Window.partitionBy("run").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    placed = hours.withColumn("_first", F.coalesce(F.sum("n_updates").over(before), F.lit(0)))
    each = placed.select("run", "_first", F.explode(F.arrays_zip("offsets", "values")).alias("i")).select(
        "run", (F.col("_first") + F.col("i.offsets")).alias("step"), F.col("i.values").alias("val"))
    least = F.min("val").over(Window.partitionBy("run").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    better = each.withColumn("_least", least).where(F.col("_least").isNull() | (F.col("val") < F.col("_least")))
    return better.drop("_least"), hours.groupBy("run").agg(F.sum("n_updates").alias("n_steps"))


def early_stops(hours: DataFrame, patience: int) -> DataFrame:
    """``(run, stopped, end_step, best_step, best_val)`` as ``logs.early_stop`` gives them:
    a run stops ``patience`` steps after an improvement that no other follows by then."""
    better, runs = _run_improvements(hours)
    following = F.lead("step").over(Window.partitionBy("run").orderBy("step"))
    better = better.withColumn("_next", following)
    better = better.join(runs.withColumnRenamed("run", "_run"), F.col("run").eqNullSafe(F.col("_run"))).drop("_run")
    last = F.col("n_steps") - 1
    stop = F.col("step") + patience
    stops = (F.coalesce("_next", F.col("n_steps")) > stop) & (stop <= last)
    state = F.struct(F.col("step").alias("best_step"), F.col("val").alias("best_val"))
    ends = better.groupBy(F.col("run").alias("_run")).agg(F.min_by(state, F.when(stops, F.col("step"))).alias("_stop"),
                                                          F.max_by(state, "step").alias("_last"))
    out = runs.join(ends, runs["run"].eqNullSafe(ends["_run"]), "left")
    at = F.coalesce("_stop", "_last")
    return out.select("run", F.col("_stop").isNotNull().alias("stopped"),
                      F.coalesce(F.col("_stop.best_step") + patience, F.col("n_steps") - 1).alias("end_step"),
                      at["best_step"].alias("best_step"), at["best_val"].alias("best_val"))
