"""Structured Streaming forms of the training meter (L1) and of stream-static
scoring (L2). Derived extensions: the reference itself has no streams.

L1: windowed n-weighted meter per run over a metric-event stream; a watermark
bounds the state of one that goes on, a bounded drain counts all rows. L2: a stream of documents scored against a static
coefficient table (broadcast, bounded by families x folds x targets).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.session import scratch_path


def wall_clock(ts) -> F.Column:
    """A zone-less time as the instant that reads so in UTC. Windows are cut at UTC
    boundaries, so days then begin at midnight of the data's own clock whatever
    the session's zone is."""
    return F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone())


def metric_stream(spark: SparkSession, path_glob: str, schema, max_files: int = 1) -> DataFrame:
    """Events as a stream ``(run, ts, event_id, val, n)``; files are picked up as they land."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path_glob)
    return raw.select(F.col("user_id").alias("run"), wall_clock(F.col("ts")).alias("ts"),
                      "event_id", F.col("value").alias("val"),
                      F.get_json_object("props", "$.k").cast("int").alias("n"))


def windowed_meter(stream: DataFrame, window: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """Per (run, window): updates, n-weighted mean. On a stream that goes on, a
    window's state is kept until the watermark passes its end, and later rows are
    dropped; a table has no watermark, and all its rows count."""
    return stream.withWatermark("ts", watermark).groupBy("run", F.window("ts", window)).agg(*_sums()) \
        .select("run", F.to_utc_timestamp(F.col("window.start"), F.current_timezone()).alias("window_start"), "n_updates",
                _average())


def _sums() -> list[F.Column]:
    return [F.count(F.lit(1)).alias("n_updates"), F.sum(F.col("val") * F.col("n")).alias("_vn"), F.sum("n").alias("_n")]


def _average() -> F.Column:
    return F.try_divide(F.col("_vn"), F.col("_n")).alias("avg")


def score_stream(docs_stream: DataFrame, coef: DataFrame, x: str, targets) -> DataFrame:
    """Stream-static join: each arriving document is scored by the mean fold model."""
    from gradewell.operators.linear import univariate_predict_all_folds

    return univariate_predict_all_folds(docs_stream, coef, x, targets).select("text_id", *targets)


def run_to_table(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Drain everything available (trigger availableNow) into Parquet files in the
    shared folder and return them as a batch DataFrame."""
    path, checkpoint = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
    drain(stream, path, checkpoint)
    return spark.read.schema(stream.schema).parquet(path)


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    q = (stream.writeStream.outputMode("append").format("parquet")
         .option("path", path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def meter_to_table(spark: SparkSession, stream: DataFrame, window: str = "1 day",
                   watermark: str = "1 day") -> DataFrame:
    """All windows of the meter over what a metric stream holds now.

    A bounded drain counts every row, in whatever order its files come: the stream
    writes its rows to the shared folder without state or watermark, and the meter
    then runs over all of them. Rows without a time form a window of their own,
    whose start is null. ``watermark`` bounds state only where a stream goes on.
    """
    rows = run_to_table(spark, stream)
    timeless = rows.where("ts IS NULL").groupBy("run").agg(*_sums())
    return windowed_meter(rows, window, watermark).unionByName(
        timeless.select("run", F.lit(None).cast("timestamp").alias("window_start"), "n_updates", _average()))
