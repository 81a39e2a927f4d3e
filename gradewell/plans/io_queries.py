"""Source/sink round trips over data derived from the driver tables.

Writes go to fresh sub-folders of the shared checkpoint folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewell.config import SEEDS
from gradewell.operators import logs, pseudo
from gradewell.plans import common as c
from gradewell.plans.log_queries import SQL_LOG
from gradewell.plans.registry import query
from gradewell.plans.scoring_queries import _sql_pseudo
from gradewell.session import scratch_path
from gradewell.sources import files, split_csv, tables

TG = c.TARGETS
OOF_SCHEMA = T.StructType(
    [T.StructField("text_id", T.LongType(), False), T.StructField("fold", T.IntegerType(), False)]
    + [T.StructField(t, T.DoubleType(), True) for t in TG]
    + [T.StructField(f"pred_{t}", T.DoubleType(), True) for t in TG])


@query("oof_roundtrip", "A1 A2 A3 A4 J7", sql=lambda: f"""
SELECT text_id, fold, {', '.join(TG)}, {', '.join(f'round(pred_{t}, 6) AS pred_{t}' for t in TG)}
FROM ({c.sql_oof()})""")
def oof_roundtrip(spark, sf):
    """OOF rows written as header CSV and as fold-partitioned Parquet, read back
    with an explicit schema (CSV fails fast on a malformed row)."""
    oof = c.oof(spark, sf).select(*[f.name for f in OOF_SCHEMA.fields])
    csv_path = scratch_path(spark, "oof-csv")
    files.write_csv(oof, csv_path)
    from_csv = files.read_csv(spark, csv_path, OOF_SCHEMA)
    pq_path = scratch_path(spark, "oof-parquet")
    files.write_oof(from_csv, pq_path)
    back = files.read_oof(spark, pq_path)
    return back.select("text_id", F.col("fold").cast("int").alias("fold"), *TG,
                       *[c.r6(f"pred_{t}").alias(f"pred_{t}") for t in TG])


@query("metric_log_append", "A10 E5", sql=f"""
SELECT CAST(run AS VARCHAR) AS run, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS epoch,
       'mean_loss' AS name, round(avg(val), 6) AS value, CAST(sum(n) AS BIGINT) AS n
FROM ({SQL_LOG}) GROUP BY 1, 2""")
def metric_log_append(spark, sf):
    """Per (run, epoch) mean loss appended to a metric-log table and read back
    (repeated appends are covered by the I/O tests)."""
    log = tables.metric_log(spark, sf)
    scores = logs.epoch_scores(log).join(
        log.groupBy("run", F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("epoch"))
        .agg(F.sum("n").alias("n")), ["run", "epoch"])
    rows = scores.select(F.col("run").cast("string").alias("run"), F.lit(None).cast("int").alias("fold"),
                         "epoch", F.lit(None).cast("long").alias("step"), F.lit("mean_loss").alias("name"),
                         F.col("score").alias("value"), "n")
    path = scratch_path(spark, "metric-log")
    files.log_metrics(rows, path)
    back = spark.read.parquet(path)
    return back.select("run", "epoch", "name", c.r6("value").alias("value"), "n")


@query("essays_csv", "A1 A2 A3", sql=f"""
SELECT text_id, full_text, {', '.join(TG)} FROM ({c.SQL_ESSAYS})""")
def essays_csv(spark, sf):
    """Labelled essays written as CSV, their texts over many lines, and read back by
    tasks that each take a part of a file."""
    schema = T.StructType([T.StructField("text_id", T.LongType()), T.StructField("full_text", T.StringType())]
                          + [T.StructField(t, T.DoubleType()) for t in TG])
    path = scratch_path(spark, "essays-csv")
    files.write_csv(tables.essays(spark, sf).select(*schema.names), path)
    return split_csv.read_split_csv(spark, path, schema)


FILE_KEYS = r"submission_([^/]+)_gpu(\d+)_fold(\d+)_best"


@query("pseudo_files", "A3 A6 C2 E9 F1 G5 J14 J15", sql=lambda: " UNION ALL ".join(map(_sql_pseudo, SEEDS)))
def pseudo_files(spark, sf):
    """Pseudo labels as files: the pool scored by each (model, seed, fold) is written as CSV
    under that key's name; files are found by name, one for each key, and their rows
    joined with the pool's texts and added to the training part of their fold."""
    path = scratch_path(spark, "pseudo-files")
    texts = tables.table(spark, sf, "documents").select(
        F.col("doc_id").alias("text_id"), F.coalesce("text", F.lit("")).alias("full_text"))
    bases = [c.essays_folds(spark, sf, seed) for seed in SEEDS]
    for i, base in enumerate(bases):
        labels = pseudo.pool_labels(base, c.unlabelled_features(spark, sf), "x_chars", TG)
        name = F.format_string("submission_chars_gpu%d_fold%d_best", F.lit(i), F.col("fold"))
        labels.select(name.alias("name"), "text_id", *TG).write.partitionBy("name").mode("append") \
            .option("header", True).csv(path)
    names = ["model", "gpu", "fold"]
    found = files.discover(spark, path, FILE_KEYS, names, glob="*.csv")
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    keys = files.unique_match(found.select(folder.alias("path"), *names).distinct(), names)
    schema = T.StructType([T.StructField("text_id", T.LongType())] + [T.StructField(t, T.DoubleType()) for t in TG])
    rows = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(path)
    rows = rows.withColumn("path", F.regexp_extract("_metadata.file_path", "^(.*)/[^/]*$", 1))
    # a row for each (model, seed, fold)
    labels = rows.join(F.broadcast(keys), "path").withColumn("fold", F.col("fold").cast("int"))
    parts = []
    for i, base in enumerate(bases):
        train = base.select("text_id", "fold", *TG).join(texts, "text_id")
        own = labels.where(F.col("gpu") == str(i)).select("fold", "text_id", *TG)
        out = pseudo.augment(train, own, texts, "fold", TG, text_col="full_text")
        parts.append(out.select(F.lit("chars").alias("model"), F.lit(SEEDS[i]).alias("seed"), "fold", "text_id", "role",
                                *[c.r6(t).alias(t) for t in TG], "full_text"))
    return reduce(DataFrame.unionByName, parts)
