"""Driver tables and the derived views the engine works on.

Every view is a lazy DataFrame over the parquet files, so Catalyst prunes
columns and pushes filters into the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.config import DRIVER_TARGETS

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def essays(spark: SparkSession, sf_dir: str, targets=DRIVER_TARGETS) -> DataFrame:
    """Labelled essays: ``(text_id, full_text, <targets> DOUBLE)``."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("text_id"), F.coalesce("text", F.lit("")).alias("full_text"))
    lab = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("text_id"), *[F.col(t).cast("double").alias(t) for t in targets])
    return lab.join(docs, "text_id", "inner")


def unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled essays (the test side): documents with no labels row."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("text_id"), F.coalesce("text", F.lit("")).alias("full_text"))
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("text_id"))
    return docs.join(lab, "text_id", "left_anti")


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered text fragments ``(id, ord, text)``; ``ord`` is the explicit order key."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("id"), F.col("turn").alias("ord"), "text")


def token_states(spark: SparkSession, sf_dir: str, layers: int = 4, width: int = 16,
                 positions: int = 16) -> DataFrame:
    """Hidden-state view ``(doc_id, layer, pos, mask, vec ARRAY<DOUBLE>)`` from ``embeddings``.

    doc = vec_id div positions, pos = vec_id mod positions, layer l is the l-th
    slice of ``width`` values, mask = 1 when pos < 4 + doc mod 13 (so every
    document has padded tail positions).
    """
    emb = table(spark, sf_dir, "embeddings")
    doc = F.expr(f"vec_id div {positions}")
    pos = F.pmod(F.col("vec_id"), F.lit(positions)).cast("int")
    base = emb.select(
        doc.alias("doc_id"), pos.alias("pos"),
        F.col("embedding").cast("array<double>").alias("embedding"))
    layer_arr = F.array(*[F.struct(F.lit(l).alias("layer"),
                                   F.slice("embedding", l * width + 1, width).alias("vec"))
                          for l in range(layers)])
    mask = F.when(F.col("pos") < F.lit(4) + F.pmod(F.col("doc_id"), F.lit(13)), 1).otherwise(0)
    return (base.select("doc_id", "pos", F.inline(layer_arr))
            .withColumn("mask", mask.cast("int"))
            .select("doc_id", "layer", "pos", "mask", "vec"))


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training-log view of ``events``: ``(run, ts, event_id, val, n)``.

    run = user_id, step order = (ts, event_id), val = value (the loss), n = the
    ``k`` field of the JSON props (the batch size weight of the meter).
    """
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").alias("run"), F.col("ts"), "event_id", F.col("value").alias("val"),
        F.get_json_object("props", "$.k").cast("int").alias("n"))


def text_features(text: Column) -> dict[str, Column]:
    """Cheap scalar text features used by the SQL-expressible baseline models."""
    n_chars = F.length(text)
    # counts by literal removal: no regex and no intermediate arrays
    n_lines = F.lit(1) + n_chars - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    n_words = F.lit(1) + n_chars - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return {
        "x_chars": F.log1p(n_chars.cast("double")),
        "x_lines": F.log1p(n_lines.cast("double")),
        "x_words": F.log1p(n_words.cast("double")),
    }
