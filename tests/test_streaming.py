"""Structured Streaming meter and stream-static scoring."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from gradewell.operators import linear, logs
from gradewell.plans import common as c
from gradewell.sources import tables
from gradewell.streaming import meter, stateful


def test_windowed_meter_equals_batch(spark):
    schema = tables.table(spark, SF_SMALL, "events").schema
    out = meter.meter_to_table(spark, meter.metric_stream(spark, f"{SF_SMALL}/events*.parquet", schema))
    log = tables.metric_log(spark, SF_SMALL)
    batch = log.groupBy("run", F.date_trunc("day", F.col("ts")).cast("timestamp").alias("window_start")).agg(
        F.count(F.lit(1)).alias("n_updates"),
        F.try_divide(F.sum(F.col("val") * F.col("n")), F.sum("n")).alias("avg"))
    rows = lambda df: sorted(tuple(r) for r in df.withColumn("avg", F.round("avg", 9)).collect())
    assert rows(out.select("run", "window_start", "n_updates", "avg")) == rows(batch)


def test_meter_over_several_files_in_time_order(spark, tmp_path):
    log = tables.table(spark, SF_SMALL, "events")
    for i, half in enumerate(("ts < '2024-01-15'", "ts >= '2024-01-15'")):
        log.where(half).coalesce(1).write.parquet(str(tmp_path / f"events{i}"))
    stream = meter.metric_stream(spark, str(tmp_path / "events*"), log.schema)
    assert meter.meter_to_table(spark, stream).agg(F.sum("n_updates")).first()[0] == log.count()


def test_meter_over_several_files_in_reverse_time_order(spark, tmp_path):
    log = tables.table(spark, SF_SMALL, "events")
    late = log.limit(3).withColumn("ts", F.lit(None).cast(log.schema["ts"].dataType))
    days = [log.where("ts >= '2024-01-20'"), log.where("ts >= '2024-01-10' AND ts < '2024-01-20'"),
            log.where("ts < '2024-01-10'"), late]
    for i, part in enumerate(days):
        part.coalesce(1).write.parquet(str(tmp_path / f"events{i}"))
    events = spark.read.schema(log.schema).parquet(*[str(tmp_path / f"events{i}") for i in range(len(days))])
    stream = meter.metric_stream(spark, str(tmp_path / "events*"), log.schema)
    got = meter.meter_to_table(spark, stream).select("run", "window_start", "n_updates", F.round("avg", 9).alias("avg"))
    n = F.get_json_object("props", "$.k").cast("int")
    want = events.groupBy(F.col("user_id").alias("run"), F.date_trunc("day", "ts").cast("timestamp").alias("window_start")).agg(
        F.count(F.lit(1)).alias("n_updates"), F.round(F.try_divide(F.sum(F.col("value") * n), F.sum(n)), 9).alias("avg"))
    key = lambda r: str(tuple(r))
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_stream_static_scoring(spark, tmp_path):
    docs = c.featurised(tables.unlabelled(spark, SF_SMALL)).select("text_id", "x_chars")
    docs.write.parquet(str(tmp_path / "docs"))
    coef = linear.univariate_fold_fit(c.essays_folds(spark, SF_SMALL), "x_chars", c.TARGETS)
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs"))
    scored = meter.run_to_table(spark, meter.score_stream(stream, coef, "x_chars", c.TARGETS))
    batch = linear.univariate_predict_all_folds(docs, coef, "x_chars", c.TARGETS).select("text_id", *c.TARGETS)
    assert scored.count() == docs.count()
    assert scored.exceptAll(batch).count() == 0


def test_state_over_files_in_any_order_equals_the_batch(spark, tmp_path):
    """Rows dealt at random into files, unknown values, a late row that is the first of all, and a run of nulls."""
    import random

    rng = random.Random(4)
    rows = [(run, i * 1000 + run, 3_600_000_000 * (i // 3) + rng.randint(0, 3_599) * 1_000_000,
             None if rng.random() < 0.2 or run == 3 else float(rng.randint(0, 40)), rng.choice([None, 0, 1, 5]))
            for run in (1, 2, 3) for i in range(80)]
    log = spark.createDataFrame(rows, "run long, event_id long, us long, val double, n int").select(
        "run", F.timestamp_micros("us").alias("ts"), "event_id", "val", "n").cache()
    for i in range(6):
        part = log.where(F.pmod(F.xxhash64("event_id"), F.lit(6)) == i)
        part.coalesce(1).write.parquet(str(tmp_path / f"log{i}"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log*"))
    hours = stateful.drain(spark, stream).cache()
    assert hours.agg(F.sum("n_updates")).first()[0] == len(rows) and hours.count() < len(rows)
    key = lambda r: str(tuple(r))
    steps = logs.with_steps(log.withColumn("ts", F.col("ts").cast("timestamp_ntz")), sizes=False)
    for patience in (1, 4, 15, 500):
        got, want = stateful.early_stops(hours, patience), logs.early_stop(steps, patience)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(*got.columns).collect()), key=str)
    days = stateful.daily_meter(hours).select("run", "day", "n_updates", F.round("avg", 9).alias("avg"))
    known = log.where("val is not null")
    want = log.groupBy("run", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n_updates"), F.round(
        F.try_divide(F.coalesce(F.sum(F.col("val") * F.col("n")), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))), 9).alias("avg"))
    assert sorted(days.collect(), key=key) == sorted(want.collect(), key=key) and known.count() < log.count()


def test_a_stream_without_rows_has_no_hours(spark, tmp_path):
    schema = "run long, ts timestamp, event_id long, val double, n int"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none"))
    hours = stateful.drain(spark, spark.readStream.schema(schema).parquet(str(tmp_path / "none")))
    assert stateful.early_stops(hours, 3).count() == 0 and stateful.daily_meter(hours).count() == 0
