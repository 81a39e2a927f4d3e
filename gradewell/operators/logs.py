"""Training-log analytics over a metric log ``(run, ts, event_id, val, n)``.

The reference keeps these as loop state (meters, best-so-far, patience
counters); here they are window computations. Running aggregates per run use
``bucketed_running`` and step numbers use ``global_row_index``, so a run that
holds a third of the log is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewell.operators.rowindex import bucketed_running, global_row_index

ORDER = ("ts", "event_id")


def with_steps(log: DataFrame, run: str = "run", sizes: bool = True) -> DataFrame:
    """Add 0-based ``step`` (order: ts, event_id), an hour ``bucket``
    (order-compatible with the steps) and, with ``sizes``, the run length
    ``n_steps`` (one aggregation joined back by run)."""
    numbered = global_row_index(log, list(ORDER), strata=[run],
                                bucket=F.date_trunc("hour", F.col("ts")), name="_rn")
    out = numbered.withColumn("step", F.col("_rn") - 1).drop("_rn") \
        .withColumn("bucket", F.date_trunc("hour", F.col("ts")))
    if sizes:
        counts = log.groupBy(F.col(run).alias("_run")).agg(F.count(F.lit(1)).alias("n_steps"))
        out = out.join(counts, out[run].eqNullSafe(counts["_run"])).drop("_run")
    return out


def running_meter(log: DataFrame, run: str = "run") -> DataFrame:
    """n-weighted running average after every update (AverageMeter as a window)."""
    prep = log.withColumn("_vn", F.col("val") * F.col("n")) \
        .withColumn("bucket", F.date_trunc("hour", F.col("ts")))
    run_sums = bucketed_running(prep, [run], list(ORDER), "bucket",
                                {"_sum": ("sum", "_vn"), "_cnt": ("sum", "n")})
    return run_sums.withColumn("avg", F.try_divide(F.col("_sum"), F.col("_cnt"))) \
        .drop("_sum", "_cnt", "_vn")


def meter_total(log: DataFrame, run: str = "run") -> DataFrame:
    """Per run: updates, last value, n-weighted average (final meter state)."""
    return log.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_updates"),
        F.max_by("val", F.struct(*ORDER)).alias("last_val"),
        F.try_divide(F.sum(F.col("val") * F.col("n")), F.sum("n")).alias("avg"))


def epoch_scores(log: DataFrame, run: str = "run") -> DataFrame:
    """Per (run, epoch): mean value; epoch = day number of ts."""
    epoch = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))
    return log.groupBy(run, epoch.alias("epoch")).agg(F.avg("val").alias("score"))


def _known(value: str, step: str) -> Column:
    """Order by value and then step; NULL, and so passed over by min, where the value is."""
    return F.when(F.col(value).isNotNull(), F.struct(value, step))


def best_epoch(scores: DataFrame, run: str = "run") -> DataFrame:
    """Best epoch with strict improvement: ties keep the earliest epoch.

    ``scores`` has one row per (run, epoch) — bounded by the epochs of a run —
    so the window per run is small. A NULL score is no improvement and never the best;
    without any other score the best is NULL.
    """
    prev = Window.partitionBy(run).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    flagged = scores.withColumn("_prev_min", F.min("score").over(prev)).withColumn(
        "_improved", F.col("score").isNotNull()
        & (F.col("_prev_min").isNull() | (F.col("score") < F.col("_prev_min"))))
    return flagged.groupBy(run).agg(
        F.min_by("epoch", _known("score", "epoch")).alias("best_epoch"),
        F.min("score").alias("best_score"),
        F.count(F.when(F.col("_improved"), 1)).alias("n_improvements"),
        F.count(F.lit(1)).alias("n_epochs"))


def best_checked(stepped: DataFrame, every: int, run: str = "run") -> DataFrame:
    """Best value among steps checked every ``every`` steps; ties keep the earliest, and a
    NULL value is checked but never the best."""
    checked = stepped.where(F.pmod(F.col("step"), F.lit(every)) == 0)
    return checked.groupBy(run).agg(
        F.min_by("step", _known("val", "step")).alias("best_step"),
        F.min("val").alias("best_val"),
        F.count(F.lit(1)).alias("n_checks"))


def early_stop(stepped: DataFrame, patience: int, run: str = "run") -> DataFrame:
    """First step with ``step - best_step_so_far >= patience``; best as of that step
    (or of the last step when the run never stops).

    Rows ``(run, stopped, end_step, best_step, best_val)``; ``end_step`` is the
    stopping step, or the last step when ``stopped`` is false. A NULL value never
    improves; before the first known value there is no best and no stop.
    """
    # running min of (val, step): the best value so far and, among equal
    # values, its earliest step -- i.e. the last strict improvement
    running = bucketed_running(stepped, [run], ["step"], "bucket",
                               {"_best": ("min", _known("val", "step"))})
    best = running.withColumn("best_step", F.col("_best.step")) \
        .withColumn("best_val", F.col("_best.val"))
    cond = F.col("step") - F.col("best_step") >= F.lit(patience)
    state = F.struct("step", "best_step", "best_val")
    # one aggregation per run: the state at the first stopping step (min_by
    # skips rows whose ordering value is NULL) or, failing that, at the last step
    ends = best.groupBy(run).agg(
        F.min_by(state, F.when(cond, F.col("step"))).alias("_stop"),
        F.max_by(state, F.col("step")).alias("_last"))
    at = F.coalesce("_stop", "_last")
    return ends.select(run, F.col("_stop").isNotNull().alias("stopped"),
                       at["step"].alias("end_step"), at["best_step"].alias("best_step"),
                       at["best_val"].alias("best_val"))


def report_rows(stepped: DataFrame, every: int) -> DataFrame:
    """Rows printed by the loop: every ``every``-th step and the last step."""
    return stepped.where((F.pmod(F.col("step"), F.lit(every)) == 0) |
                         (F.col("step") == F.col("n_steps") - 1))


def as_minutes(seconds) -> F.Column:
    m = F.floor(seconds / F.lit(60))
    s = F.floor(seconds - m * F.lit(60))
    return F.concat(m.cast("string"), F.lit("m "), s.cast("string"), F.lit("s"))


def eta(stepped: DataFrame, every: int, run: str = "run") -> DataFrame:
    """Elapsed and remaining time at each reported step, formatted ``Xm Ys``.

    remaining = elapsed / fraction_done - elapsed, fraction_done = (step+1)/n_steps.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    starts = stepped.groupBy(F.col(run).alias("_run")).agg(F.min(micros).alias("_t0"))
    rep = report_rows(stepped, every)
    rep = rep.join(starts, rep[run].eqNullSafe(starts["_run"])).drop("_run")
    elapsed = (micros - F.col("_t0")) / F.lit(1e6)
    pct = (F.col("step") + 1) / F.col("n_steps")
    remain = elapsed / pct - elapsed
    return rep.select(run, "step", as_minutes(elapsed).alias("elapsed"),
                      as_minutes(remain).alias("remain"))
