"""Pseudo labels: score the unlabelled pool with every fold's model and
append the rows to that fold's training part only.

The key (fold) ties each pseudo row to the model that produced it, so the
held-out rows of fold f never influenced the labels added to fold f, and
pseudo rows never reach a validation set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.operators import linear


def pool_labels(labelled_folds: DataFrame, pool_features: DataFrame, x: str,
                targets: Sequence[str], fold_col: str = "fold") -> DataFrame:
    """``(fold, text_id, t…)``: the pool scored by each fold's model (J14, reduce='none').

    Pool rows are repeated once per fold with a generator (k from a scalar
    subquery) and equi-joined to the k-row coefficient table (broadcast).
    """
    coef = linear.univariate_fold_fit(labelled_folds, x, targets, fold_col=fold_col)
    k_max = coef.agg(F.max(fold_col)).scalar()
    feats = pool_features.select("text_id", x)
    per_fold = feats.withColumn(fold_col, F.explode(F.sequence(F.lit(0), k_max)))
    scored = linear.univariate_predict(per_fold, coef, x, targets, fold_col=fold_col, prefix="")
    return scored.select(fold_col, "text_id", *targets)


def augment(train_folds: DataFrame, labels: DataFrame, texts: DataFrame,
            fold_col: str, targets: Sequence[str], text_col: str | None = None) -> DataFrame:
    """Per split f: labelled rows with fold != f (role 'train') union the pseudo
    rows keyed to f (role 'pseudo').

    With ``text_col`` both sides carry that column, the pseudo rows from ``texts``
    by an equi-join on the id; without it no join is made.
    """
    carried = [text_col] if text_col else []
    k_max = train_folds.agg(F.max(fold_col)).scalar()
    train = train_folds.withColumn("_split", F.explode(F.sequence(F.lit(0), k_max))) \
        .where(F.col("_split") != F.col(fold_col)) \
        .select(F.col("_split").alias(fold_col), "text_id", F.lit("train").alias("role"), *targets, *carried)
    if text_col:
        labels = labels.join(texts.select("text_id", text_col), "text_id", "inner")
    pseudo = labels.select(fold_col, "text_id", F.lit("pseudo").alias("role"), *targets, *carried)
    return train.unionByName(pseudo)
