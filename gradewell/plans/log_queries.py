"""Training-log analytics on the ``events`` table read as a metric log.

run = user_id, order = (ts, event_id), val = value, n = props.k.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewell.config import CHECK_EVERY, REPORT_EVERY
from gradewell.operators import logs
from gradewell.plans.common import r6
from gradewell.plans.registry import query
from gradewell.session import scratch_path
from gradewell.sources import tables

PATIENCE = 20

SQL_LOG = """
  SELECT user_id AS run, ts, event_id, value AS val,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS n FROM events"""

SQL_STEPS = f"""
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts, event_id) - 1 AS step,
         count(*) OVER (PARTITION BY run) AS n_steps FROM ({SQL_LOG})"""


def _log(spark, sf):
    return tables.metric_log(spark, sf)


def _steps(spark, sf):
    return logs.with_steps(_log(spark, sf))


@query("meter_running", "D7 E4", sql=f"""
SELECT run AS user_id, event_id,
       round(sum(val * n) OVER w / nullif(sum(n) OVER w, 0), 6) AS avg
FROM ({SQL_LOG})
WINDOW w AS (PARTITION BY run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def meter_running(spark, sf):
    m = logs.running_meter(_log(spark, sf))
    return m.select(F.col("run").alias("user_id"), "event_id", r6("avg").alias("avg"))


@query("meter_total", "D7", sql=f"""
SELECT run AS user_id, count(*) AS n_updates, arg_max_null(val, ts) AS last_val,
       round(sum(val * n) / nullif(sum(n), 0), 6) AS avg
FROM ({SQL_LOG}) GROUP BY run""")
def meter_total(spark, sf):
    m = logs.meter_total(_log(spark, sf))
    return m.select(F.col("run").alias("user_id"), "n_updates", "last_val", r6("avg").alias("avg"))


@query("best_epoch", "E5", sql=f"""
WITH s AS (SELECT run, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS epoch,
                  avg(val) AS score FROM ({SQL_LOG}) GROUP BY 1, 2),
     f AS (SELECT *, min(score) OVER (PARTITION BY run ORDER BY epoch
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_min FROM s),
     b AS (SELECT run, epoch, score, row_number() OVER (PARTITION BY run ORDER BY score, epoch) AS r FROM s)
SELECT f.run AS user_id, CASE WHEN b.score IS NOT NULL THEN b.epoch END AS best_epoch, round(b.score, 6) AS best_score,
       count(*) FILTER (WHERE f.score IS NOT NULL AND (prev_min IS NULL OR f.score < prev_min)) AS n_improvements,
       count(*) AS n_epochs
FROM f JOIN b ON f.run IS NOT DISTINCT FROM b.run AND b.r = 1 GROUP BY f.run, b.epoch, b.score""")
def best_epoch(spark, sf):
    b = logs.best_epoch(logs.epoch_scores(_log(spark, sf)))
    return b.select(F.col("run").alias("user_id"), "best_epoch", r6("best_score").alias("best_score"),
                    "n_improvements", "n_epochs")


@query("best_iteration", "E6 E9 K5", sql=f"""
WITH c AS (SELECT * FROM ({SQL_STEPS}) WHERE step % {CHECK_EVERY} = 0),
     b AS (SELECT run, step, val, row_number() OVER (PARTITION BY run ORDER BY val, step) AS r,
                  count(*) OVER (PARTITION BY run) AS n_checks FROM c)
SELECT run AS user_id, CASE WHEN val IS NOT NULL THEN step END AS best_step, val AS best_val, n_checks
FROM b WHERE r = 1""")
def best_iteration(spark, sf):
    b = logs.best_checked(_steps_only(spark, sf), CHECK_EVERY)
    return b.select(F.col("run").alias("user_id"), "best_step", "best_val", "n_checks")


def _steps_only(spark, sf):
    return logs.with_steps(_log(spark, sf), sizes=False)


SQL_EARLY_STOP = f"""
WITH s AS ({SQL_STEPS}),
     p AS (SELECT *, min(val) OVER (PARTITION BY run ORDER BY step
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_min FROM s),
     q AS (SELECT *, max(CASE WHEN val IS NOT NULL AND (prev_min IS NULL OR val < prev_min) THEN step END)
                       OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_step,
                     min(val) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_val
           FROM p),
     e AS (SELECT run, min(CASE WHEN step - best_step >= {PATIENCE} THEN step END) AS stop_step,
                  max(step) AS last_step FROM q GROUP BY run)
SELECT q.run AS user_id, e.stop_step IS NOT NULL AS stopped, q.step AS end_step, q.best_step, q.best_val
FROM q JOIN e ON q.run IS NOT DISTINCT FROM e.run AND q.step = coalesce(e.stop_step, e.last_step)"""


@query("early_stop", "E7 E5", sql=SQL_EARLY_STOP)
def early_stop(spark, sf):
    e = logs.early_stop(_steps_only(spark, sf), PATIENCE)
    return e.select(F.col("run").alias("user_id"), "stopped", "end_step", "best_step", "best_val")


@query("report_steps", "E8", sql=f"""
SELECT run AS user_id, step, val FROM ({SQL_STEPS})
WHERE step % {REPORT_EVERY} = 0 OR step = n_steps - 1""")
def report_steps(spark, sf):
    r = logs.report_rows(_steps(spark, sf), REPORT_EVERY)
    return r.select(F.col("run").alias("user_id"), "step", "val")


def _sql_minutes(x: str) -> str:
    return (f"CAST(floor(({x}) / 60) AS BIGINT) || 'm ' || "
            f"CAST(floor(({x}) - floor(({x}) / 60) * 60) AS BIGINT) || 's'")


@query("eta_report", "E11", sql=f"""
WITH s AS ({SQL_STEPS}),
     t AS (SELECT run, min(epoch_us(ts)) AS t0 FROM s GROUP BY run),
     r AS (SELECT s.run, s.step, (epoch_us(s.ts) - t.t0) / 1e6 AS el, (s.step + 1) / n_steps AS pct
           FROM s JOIN t ON s.run = t.run
           WHERE s.step % {REPORT_EVERY} = 0 OR s.step = s.n_steps - 1)
SELECT run AS user_id, step, {_sql_minutes('el')} AS elapsed, {_sql_minutes('el / pct - el')} AS remain FROM r""")
def eta_report(spark, sf):
    e = logs.eta(_steps(spark, sf), REPORT_EVERY)
    return e.select(F.col("run").alias("user_id"), "step", "elapsed", "remain")


SQL_DAYS = f"""
SELECT run AS user_id, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       count(*) AS n_updates, round(sum(val * n) / nullif(sum(n), 0), 6) AS avg
FROM ({SQL_LOG}) GROUP BY run, date_trunc('day', ts)"""


@query("meter_stream", "D7 E4 (L1 streaming)", sql=SQL_DAYS)
def meter_stream(spark, sf):
    """The meter's daily windows over the events files, read as a stream that is
    drained with an availableNow trigger; every row counts."""
    from gradewell.streaming import meter

    schema = tables.table(spark, sf, "events").schema
    stream = meter.metric_stream(spark, f"{sf.rstrip('/')}/events*.parquet", schema)
    out = meter.meter_to_table(spark, stream)
    return out.select(F.col("run").alias("user_id"),
                      F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                      "n_updates", r6("avg").alias("avg"))


def _event_files(spark, sf):
    """The events dealt into eight files at random, for streams that take one at a time."""
    path = scratch_path(spark, "event-files")
    tables.table(spark, sf, "events").repartition(8, F.xxhash64("event_id")).write.parquet(path)
    return path


@query("meter_state_stream", "D7 E4 (L1 streaming)", sql=SQL_DAYS)
def meter_state_stream(spark, sf):
    """Daily windows from the state of a stream over eight files in no order of time."""
    from gradewell.streaming import meter, stateful

    stream = meter.metric_stream(spark, _event_files(spark, sf), tables.table(spark, sf, "events").schema)
    days = stateful.daily_meter(stateful.drain(spark, stream))
    start = F.to_utc_timestamp("day", F.current_timezone())
    return days.select(F.col("run").alias("user_id"), F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                       "n_updates", r6("avg").alias("avg"))


@query("early_stop_stream", "E5 E7 (L1 streaming)", sql=SQL_EARLY_STOP)
def early_stop_stream(spark, sf):
    """Early stops from the same state: best value so far and patience of each run."""
    from gradewell.streaming import meter, stateful

    stream = meter.metric_stream(spark, _event_files(spark, sf), tables.table(spark, sf, "events").schema)
    e = stateful.early_stops(stateful.drain(spark, stream), PATIENCE)
    return e.select(F.col("run").alias("user_id"), "stopped", "end_step", "best_step", "best_val")
