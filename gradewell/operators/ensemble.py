"""Keyed ensembling: predictions are paired by id, never by row position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keyed_mean(subs: DataFrame, key: str, targets: Sequence[str]) -> DataFrame:
    """Element-wise mean of K submissions stacked long by a ``model`` column."""
    return subs.groupBy(key).agg(*[F.avg(t).alias(t) for t in targets])


def weighted_blend(subs: DataFrame, weights: DataFrame, key: str,
                   targets: Sequence[str]) -> DataFrame:
    """sum(w_i p_i) / sum(w_i) per key.

    ``weights`` has one row per model (bounded by the number of models), so it
    is broadcast; the blend is one aggregation keyed by id. Weights that sum to 0 give NULL.
    """
    j = subs.join(F.broadcast(weights), "model", "inner")
    return j.groupBy(key).agg(*[F.try_divide(F.sum(F.col("w") * F.col(t)), F.sum("w")).alias(t)
                                for t in targets])


def inverse_weights(scores: DataFrame, score_col: str = "score") -> DataFrame:
    """``(model, w)``: w = 1 / score (D11). Where a model has no error at all, such models
    share the whole weight; a model without a score has none."""
    least = scores.agg(F.min(score_col)).scalar()
    w = F.when(least == 0, (F.col(score_col) == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col(score_col)))
    return scores.select("model", F.coalesce(w, F.lit(0.0)).alias("w"))


def rank_models(scores: DataFrame, score_col: str) -> DataFrame:
    """Leaderboard: rank 1 = lowest error. One row per model, so a global
    window over it is a window over a handful of rows."""
    w = Window.orderBy(F.col(score_col), F.col("model"))
    return scores.withColumn("rank", F.row_number().over(w).cast("int"))


def fill_template(template: DataFrame, preds: DataFrame, key: str,
                  targets: Sequence[str]) -> DataFrame:
    """Drop the template's placeholder grades and left-join predictions by key."""
    ids = template.drop(*targets)
    return ids.join(preds.select(key, *targets), key, "left")


def project_like(df: DataFrame, template_columns: Sequence[str]) -> DataFrame:
    """Restrict and reorder to a template's columns."""
    return df.select(*template_columns)
