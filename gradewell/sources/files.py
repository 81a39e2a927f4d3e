"""File sources and sinks: CSV in/out, OOF tables, feature store, model
registry, metric log, and key discovery from file names.

CSV is read with an explicit schema and fail-fast parsing: small files whole, one
task each; large ones by ``split_csv``, which cuts a file into records over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewell.config import REFERENCE_TARGETS
from gradewell.sources import committed

ESSAY_SCHEMA = T.StructType(
    [T.StructField("text_id", T.StringType(), False), T.StructField("full_text", T.StringType(), True)]
    + [T.StructField(t, T.DoubleType(), True) for t in REFERENCE_TARGETS])
TEST_SCHEMA = T.StructType([T.StructField("text_id", T.StringType(), False),
                            T.StructField("full_text", T.StringType(), True)])
FRAGMENT_SCHEMA = T.StructType([T.StructField("id", T.StringType(), False),
                                T.StructField("discourse_id", T.LongType(), False),
                                T.StructField("discourse_text", T.StringType(), True)])
METRIC_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in [
    ("run", T.StringType()), ("fold", T.IntegerType()), ("epoch", T.IntegerType()),
    ("step", T.LongType()), ("name", T.StringType()), ("value", T.DoubleType()),
    ("n", T.LongType())]])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV with quoted multi-line text; a malformed row fails the read (A1, A2)."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True) \
        .option("escape", '"').option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV, no index column (A3); blanks at a text's ends are kept."""
    df.write.mode(mode).option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).csv(path)


def write_oof(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """OOF rows partitioned by fold, so per-fold reads prune partitions (A4)."""
    df.write.mode(mode).partitionBy("fold").parquet(path)


def read_oof(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def feature_store_get_or_compute(spark: SparkSession, path: str, wanted: DataFrame,
                                 keys: Sequence[str],
                                 compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Feature store keyed by ``keys`` (partition columns) (A5).

    Only key combinations without a finished save are computed and saved; a run that
    was cut off left none, so its keys are computed again, and the parts it wrote are
    never read. A key whose computation gives no row is finished too. Of keys that two
    runs computed at the same time, the later save's rows count.
    """
    name = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    ask = wanted.select(*keys).distinct()
    have = committed.manifest(spark, path).select("keys").distinct()
    missing = ask.withColumn("keys", name).join(have, "keys", "left_anti").select(*keys)
    if not missing.isEmpty():
        committed.save(compute(missing), path, keys, missing.select(name.alias("keys")))
    saves = committed.manifest(spark, path)
    last = saves.groupBy("keys").agg(F.max_by("commit", F.struct("number", "commit")).alias("commit"))
    chosen = ask.withColumn("keys", name).join(last, "keys").select(*keys, "commit")
    used = saves.join(chosen.select("commit").distinct(), "commit", "left_semi")
    rows = committed.read(spark, path, used)
    if rows is None:                        # nothing was wanted
        return compute(ask)
    same = rows["commit"] == chosen["commit"]
    for k in keys:
        same = same & rows[k].eqNullSafe(chosen[k])
    return rows.join(F.broadcast(chosen), same, "left_semi").drop("commit", "number")     # a row for each key


#: What names a model: a save replaces the models with its keys, and leaves the others.
REGISTRY_KEYS = ("run", "cv_id", "model", "fold", "target")


def registry_save(df: DataFrame, path: str) -> None:
    """Add models to the registry (A7), keyed by those of ``REGISTRY_KEYS`` that the table
    has. Earlier saves stay as they are."""
    committed.save(df, path, ["run"])


def registry_load(spark: SparkSession, path: str, run: str) -> DataFrame:
    """The models of a run, of each key the one saved last."""
    rows = committed.read(spark, path)
    if rows is None:
        raise ValueError(f"no model was saved at {path}")
    rows = rows.where(F.col("run") == run)
    return committed.latest(rows, [k for k in REGISTRY_KEYS if k in rows.columns]).drop("commit", "number")


def log_metrics(df: DataFrame, path: str) -> None:
    """Append rows to the metric log table (A10)."""
    df.select(*[F.col(f.name).cast(f.dataType) for f in METRIC_SCHEMA.fields]) \
        .write.mode("append").parquet(path)


def discover(spark: SparkSession, path: str, key_regex: str, names: Sequence[str],
             glob: str = "*") -> DataFrame:
    """Files below ``path`` whose names match a glob, with keys parsed from their paths
    (A6, E9): ``(path, <names>…)``, one row per file whose whole path the regex finds.

    Only the listing is used: paths come from the files' metadata, no file is opened.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
             .load(path).select(F.col("_metadata.file_path").alias("path")))
    found = files.where(F.col("path").rlike(key_regex))
    return found.select("path", *[F.regexp_extract("path", key_regex, i + 1).alias(n) for i, n in enumerate(names)])


def unique_match(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One path per key; keys matched by several files raise at run time
    instead of silently taking the first (Q16)."""
    g = found.groupBy(*keys).agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("_n"))
    return g.select(*keys, F.when(F.col("_n") == 1, F.col("path")).otherwise(
        F.raise_error(F.concat(F.lit("ambiguous match for "), F.col("path")))).alias("path"))
