"""k-fold linear models fitted in one data pass.

Every fold's training statistics equal the total minus that fold's own
statistics, so one ``groupBy(fold)`` over the data yields the sufficient
statistics of all k training sets at once. Only a table of k x d x d numbers
reaches the driver, never rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradewell.operators.treesum import BLOCK_SCHEMA, block_sum, blocks, collect_blocks

# --------------------------------------------------------------------------
# One feature: closed form, fully inside Spark SQL expressions.
# --------------------------------------------------------------------------


#: A spread below this share of the sum of squares is rounding.
FLAT = 1e-12


def univariate_fold_fit(df: DataFrame, x: str, targets: Sequence[str], lam: float = 0.0,
                        fold_col: str = "fold") -> DataFrame:
    """Per fold: intercept ``a_<t>`` and slope ``b_<t>`` fitted on the other folds.

    Ridge penalty ``lam`` on the slope only. Returns one row per fold (k rows). A feature
    that does not vary has slope 0 and so the mean as intercept; without a training row
    the model is NULL.
    """
    aggs = [F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("sx"),
            F.sum(F.col(x) * F.col(x)).alias("sxx")]
    for t in targets:
        aggs += [F.sum(t).alias(f"sy_{t}"), F.sum(F.col(x) * F.col(t)).alias(f"sxy_{t}")]
    per_fold = df.groupBy(fold_col).agg(*aggs)
    whole = Window.partitionBy()  # k rows: the window runs over a k-row table
    stats = ["n", "sx", "sxx", *[f"s{p}_{t}" for t in targets for p in ("y", "xy")]]
    train = per_fold.select(fold_col, *[(F.sum(c).over(whole) - F.col(c)).alias(c) for c in stats])
    # what rounding leaves of the spread of a constant is no spread
    spread = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), F.col("n"))
    spread = F.when(spread > F.lit(FLAT) * F.col("sxx"), spread).otherwise(0.0) + F.lit(lam)
    out = [fold_col]
    for t in targets:
        together = F.col(f"sxy_{t}") - F.try_divide(F.col("sx") * F.col(f"sy_{t}"), F.col("n"))
        out.append(F.coalesce(F.try_divide(together, spread), F.lit(0.0)).alias(f"b_{t}"))
    fit = train.select(*out, "n", "sx", *[f"sy_{t}" for t in targets])
    return fit.select(fold_col, *[
        c for t in targets for c in (
            F.try_divide(F.col(f"sy_{t}") - F.col(f"b_{t}") * F.col("sx"), F.col("n")).alias(f"a_{t}"),
            F.col(f"b_{t}"))])


def univariate_predict(df: DataFrame, coef: DataFrame, x: str, targets: Sequence[str],
                       fold_col: str = "fold", prefix: str = "pred_") -> DataFrame:
    """Out-of-fold prediction: each row scored by the model of its own fold.

    ``coef`` has one row per fold (k rows), so it is broadcast.
    """
    joined = df.join(F.broadcast(coef), fold_col, "inner")
    return joined.select(*df.columns, *[
        (F.col(f"a_{t}") + F.col(f"b_{t}") * F.col(x)).alias(f"{prefix}{t}") for t in targets])


def univariate_predict_all_folds(df: DataFrame, coef: DataFrame, x: str,
                                 targets: Sequence[str], fold_col: str = "fold") -> DataFrame:
    """Test-side prediction averaged over the k fold models.

    The mean of k affine models is the affine model with mean coefficients, so
    the k-row coefficient table is reduced to one scalar struct first and no
    row is multiplied by k.
    """
    m = mean_coefficients(coef, targets)
    return df.select(*df.columns, *[
        (m.getField(f"a_{t}") + m.getField(f"b_{t}") * F.col(x)).alias(t) for t in targets])


def mean_coefficients(coef: DataFrame, targets: Sequence[str]):
    """Scalar subquery (one struct) holding the fold-averaged coefficients;
    evaluated once and used like a literal, so no join is needed."""
    return coef.agg(F.struct(*[F.avg(c).alias(c) for t in targets
                               for c in (f"a_{t}", f"b_{t}")]).alias("m")).scalar()


# --------------------------------------------------------------------------
# Many features: partial Gram matrices per partition (NumPy on Arrow batches),
# summed by Spark, solved on the driver (d x d per fold).
# --------------------------------------------------------------------------


def _gram_partials(feature_col: str, fold_col: str, targets: Sequence[str], d: int, fmap=None):
    t_n = len(targets)

    def fn(batches):
        acc: dict[int, list] = {}
        for pdf in batches:
            if pdf.empty:
                continue
            X = np.stack(pdf[feature_col].to_numpy()).astype(np.float64)
            if fmap is not None:
                X = fmap(X)
            X = np.hstack([np.ones((X.shape[0], 1)), X])
            Y = pdf[list(targets)].to_numpy(dtype=np.float64)
            for f, idx in pdf.groupby(fold_col).indices.items():
                xs, ys = X[idx], Y[idx]
                g = acc.setdefault(int(f), [np.zeros((d + 1, d + 1)), np.zeros((d + 1, t_n)),
                                            np.zeros(t_n), 0])
                g[0] += xs.T @ xs
                g[1] += xs.T @ ys
                g[2] += (ys * ys).sum(axis=0)
                g[3] += len(idx)
        rows = [r for f, g in acc.items()
                for r in blocks({"xtx": g[0], "xty": g[1], "yty": g[2], "n": [g[3]]}, {fold_col: f})]
        yield pd.DataFrame(rows, columns=[fold_col, "_name", "_blk", "_v", "_part"])

    return fn


def fold_gram(df: DataFrame, feature_col: str, targets: Sequence[str], d: int,
              fold_col: str = "fold", fmap=None) -> list[dict]:
    """Per-fold sufficient statistics ``{fold, xtx, xty, yty, n}`` (with intercept column),
    as driver-side rows (k of them; the solve happens on the driver).

    Each partition emits its per-fold partials (NumPy on Arrow batches) as
    fixed-size blocks; blocks are summed across partitions in parallel and
    re-assembled, so no task holds more than a block per aggregation buffer.
    """
    parts = df.select(fold_col, feature_col, *targets).mapInPandas(
        _gram_partials(feature_col, fold_col, targets, d, fmap), f"{fold_col} int, {BLOCK_SCHEMA}")
    got = collect_blocks(block_sum(parts, [fold_col]), [fold_col])
    return [{fold_col: int(k[0]), "xtx": v["xtx"], "xty": v["xty"], "yty": v["yty"], "n": int(v["n"][0])}
            for k, v in sorted(got.items())]


def solve_fold_ridge(gram_rows, d: int, n_targets: int, lam: float,
                     fold_col: str = "fold", per_row: bool = False) -> dict[int, np.ndarray]:
    """Driver-side solve: W_f = (XtX_total - XtX_f + lam*I')^-1 (XtY_total - XtY_f).

    The intercept (index 0) is not penalised. With ``per_row`` the penalty is
    ``lam`` times the fold's training-row count (the mean-loss objective).
    Returns fold -> (d+1) x T matrix.
    """
    mats = {int(r[fold_col]): (np.array(r["xtx"]).reshape(d + 1, d + 1),
                               np.array(r["xty"]).reshape(d + 1, n_targets), float(r["n"]))
            for r in gram_rows}
    tot_a = sum(m[0] for m in mats.values())
    tot_b = sum(m[1] for m in mats.values())
    tot_n = sum(m[2] for m in mats.values())
    out = {}
    for f, (a, b, n) in mats.items():
        pen = lam * (tot_n - n if per_row else 1.0) * np.eye(d + 1)
        pen[0, 0] = 0.0
        out[f] = np.linalg.solve(tot_a - a + pen, tot_b - b)
    return out


def coef_table(spark, weights: dict[int, np.ndarray], targets: Sequence[str],
               fold_col: str = "fold") -> DataFrame:
    """k x T rows ``(fold, target, intercept, w ARRAY<DOUBLE>)``."""
    rows = [(f, t, float(W[0, j]), [float(v) for v in W[1:, j]])
            for f, W in sorted(weights.items()) for j, t in enumerate(targets)]
    return spark.createDataFrame(rows, f"{fold_col} int, target string, intercept double, "
                                       "w array<double>")


def dot(a, b):
    """JVM-side dot product of two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def predict_linear(df: DataFrame, coef: DataFrame, feature_col: str,
                   on: Sequence[str] = ("fold",)) -> DataFrame:
    """Long predictions ``(…, target, pred)``: rows joined to their fold's models.

    ``coef`` holds folds x targets rows (bounded by k x T), so it is broadcast.
    """
    joined = df.join(F.broadcast(coef), list(on), "inner")
    return joined.withColumn("pred", F.col("intercept") + dot(F.col(feature_col), F.col("w"))) \
        .drop("intercept", "w")
