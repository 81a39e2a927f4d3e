"""Column-wise error metrics: per-target RMSE, MCRMSE, fold-mean and pooled CV.

One pass over the prediction rows builds the ``(group…, fold, target)``
table of squared-error sums and counts; every score level (per fold, per
target, fold mean, pooled) is derived from that small table, so no score
needs a second scan of the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.functions.losses import root_se, smooth_l1


def to_long(df: DataFrame, keys: Sequence[str], targets: Sequence[str],
            pred_prefix: str = "pred_") -> DataFrame:
    """Wide ``(keys, t…, pred_t…)`` → long ``(keys, target, y, pred)``."""
    pairs = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y"),
                               F.col(f"{pred_prefix}{t}").cast("double").alias("pred"))
                      for t in targets])
    return df.select(*keys, F.inline(pairs))


def error_table(long: DataFrame, by: Sequence[str] = ("fold",)) -> DataFrame:
    """``(by…, target, sse, n)`` in one aggregation with map-side combine."""
    d = F.col("y") - F.col("pred")
    return long.groupBy(*by, "target").agg(F.sum(d * d).alias("sse"),
                                            F.count(F.lit(1)).alias("n"))


def rmse_by_fold(errors: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """``(group…, fold, target, rmse)`` including target ``'mcrmse'`` (mean over targets)."""
    per = errors.select(*group, "fold", "target", F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))
    mc = per.groupBy(*group, "fold").agg(F.avg("rmse").alias("rmse")) \
        .withColumn("target", F.lit("mcrmse"))
    return per.unionByName(mc)


def cv_scores(errors: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Both CV definitions (they differ in general):

    * ``fold_mean``: mean over folds of each fold's score,
    * ``pooled``: the score of all out-of-fold rows taken together.
    Rows ``(group…, scope, target, score)``; target ``'mcrmse'`` is the mean over targets.
    """
    by_fold = rmse_by_fold(errors, group)
    fold_mean = by_fold.groupBy(*group, "target").agg(F.avg("rmse").alias("score")) \
        .withColumn("scope", F.lit("fold_mean"))
    pooled_t = errors.groupBy(*group, "target").agg(
        F.sqrt(F.sum("sse") / F.sum("n")).alias("score"))
    pooled_mc = pooled_t.groupBy(*group).agg(F.avg("score").alias("score")) \
        .withColumn("target", F.lit("mcrmse"))
    pooled = pooled_t.unionByName(pooled_mc).withColumn("scope", F.lit("pooled"))
    return fold_mean.unionByName(pooled).select(*group, "scope", "target", "score")


def mcrmse_wide(errors: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Per fold: ``rmse_<t>`` columns and ``mcrmse``."""
    per = errors.select("fold", "target", F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))
    wide = per.groupBy("fold").pivot("target", list(targets)).agg(F.first("rmse"))
    wide = wide.select("fold", *[F.col(t).alias(f"rmse_{t}") for t in targets])
    mean = sum((F.col(f"rmse_{t}") for t in targets), F.lit(0.0)) / F.lit(len(targets))
    return wide.withColumn("mcrmse", mean)


def loss_table(long: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """Smooth-L1 mean and root-SE (sum, mean) over residuals ``y - pred``."""
    d = F.col("y") - F.col("pred")
    return long.groupBy(*by).agg(
        F.avg(smooth_l1(d)).alias("smooth_l1"),
        F.sum(root_se(d)).alias("root_se_sum"),
        F.avg(root_se(d)).alias("root_se_mean"))
