"""Tables that grow by whole saves.

A save writes its rows under a name of its own, ``data/commit=<name>``, and then, as
the last step, one manifest row. Only saves with a manifest row are ever read: one
that was cut off leaves files that nobody sees, and its keys are still missing. Saves
are numbered, so that of two that hold the same key the later one counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "commit string, number long, schema string, keys string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(commit, number, schema, keys)``: finished saves, with a row for each key saved.

    A save of a table without keys has one row whose ``keys`` is null. Saves that ran
    at the same time may share a number; their names order them."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def save(df: DataFrame, path: str, partition_by: Sequence[str] = (), keys: DataFrame | None = None) -> str:
    """Write a table's rows as one save; ``keys`` is what it finishes, as a string column ``keys``."""
    spark, commit = df.sparkSession, uuid.uuid4().hex
    df.write.partitionBy(*partition_by).parquet(f"{path}/data/commit={commit}")
    number = (manifest(spark, path).agg(F.max("number")).first()[0] or 0) + 1
    rows = keys if keys is not None else spark.createDataFrame([(None,)], "keys string")
    entry = rows.select(F.lit(commit).alias("commit"), F.lit(number).cast("long").alias("number"),
                        F.lit(df.schema.json()).alias("schema"), "keys")
    entry.coalesce(1).write.mode("append").parquet(f"{path}/manifest")        # one file: all of it or nothing
    return commit


def read(spark: SparkSession, path: str, saves: DataFrame | None = None) -> DataFrame | None:
    """The rows of the finished saves (or of those in ``saves``), with ``commit`` and
    ``number``; None if there are none. Partition columns have the types they were saved
    with, whatever their values look like; columns that a save lacks are null."""
    import json

    found = (manifest(spark, path) if saves is None else saves).select("commit", "number", "schema").distinct().collect()
    if not found:
        return None
    fields = {f.name: f for r in sorted(found, key=lambda r: (r["number"], r["commit"]))
              for f in T.StructType.fromJson(json.loads(r["schema"])).fields}
    schema = T.StructType([*fields.values(), T.StructField("commit", T.StringType())])
    rows = (spark.read.schema(schema).option("basePath", f"{path}/data")
            .parquet(*[f"{path}/data/commit={r['commit']}" for r in found]))
    numbers = spark.createDataFrame([(r["commit"], r["number"]) for r in found], "commit string, number long")
    return rows.join(F.broadcast(numbers), "commit")           # a row for each save


def latest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of the rows of several saves, each key's of the last save that has it."""
    last = rows.groupBy(*keys).agg(F.max(F.struct("number", "commit")).alias("last"))
    same = rows["commit"] == last["last.commit"]
    for k in keys:
        same = same & rows[k].eqNullSafe(last[k])
    return rows.join(last, same, "left_semi")
