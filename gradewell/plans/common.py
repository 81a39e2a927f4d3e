"""Shared building blocks of the catalogue, each with its DuckDB twin.

The baseline model family is a per-fold affine fit of every target on one
scalar text feature (SQL can express it exactly); ``MODELS`` maps a model name
to its feature. Spark builders and SQL fragments are kept side by side so the
two stay in step.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.config import DEFAULT_SEED, DRIVER_TARGETS, N_FOLDS
from gradewell.operators import folds as fo
from gradewell.operators import linear
from gradewell.sources import tables

TARGETS = DRIVER_TARGETS
MODELS = {"chars": "x_chars", "lines": "x_lines", "words": "x_words"}
STRATA = ("quality", "toxic")


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def featurised(df: DataFrame, text_col: str = "full_text") -> DataFrame:
    feats = tables.text_features(F.col(text_col))
    return df.select("*", *[v.alias(k) for k, v in feats.items()])


def doc_features(spark: SparkSession, sf: str) -> DataFrame:
    """``(text_id, x_…)``: scalar text features computed in the documents scan,
    so document bodies never enter an exchange."""
    docs = tables.table(spark, sf, "documents")
    feats = tables.text_features(F.coalesce(F.col("text"), F.lit("")))
    return docs.select(F.col("doc_id").alias("text_id"), *[v.alias(k) for k, v in feats.items()])


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "labels").select(
        F.col("doc_id").alias("text_id"), *[F.col(t).cast("double").alias(t) for t in TARGETS])


def essays_folds(spark: SparkSession, sf: str, seed: int = DEFAULT_SEED,
                 k: int = N_FOLDS) -> DataFrame:
    """Labelled essays + text features + stratified fold (strata = label tuple).

    Folds are numbered on the small labels table alone; the documents are
    scanned once, reduced to scalar features, and joined by id. The result is
    persisted: every fit, prediction and score of a run reuses it.
    """
    lab = labelled(spark, sf)
    folds = fo.assign_folds(lab, "text_id", k, seed, strata=STRATA)
    joined = folds.join(doc_features(spark, sf), "text_id", "inner")
    # the join keeps its own parallelism; adaptive execution merges small partitions after it
    return joined.persist(StorageLevel.MEMORY_AND_DISK)


def unlabelled_features(spark: SparkSession, sf: str) -> DataFrame:
    """Unlabelled essays as ``(text_id, x_…)``; features before the anti-join."""
    ids = tables.table(spark, sf, "labels").select(F.col("doc_id").alias("text_id"))
    return doc_features(spark, sf).join(ids, "text_id", "left_anti")


def oof(spark: SparkSession, sf: str, model: str = "chars", seed: int = DEFAULT_SEED,
        k: int = N_FOLDS, base: DataFrame | None = None) -> DataFrame:
    """Out-of-fold rows ``(text_id, fold, t…, pred_t…)`` of one baseline model."""
    x = MODELS[model]
    ef = base if base is not None else essays_folds(spark, sf, seed, k)
    coef = linear.univariate_fold_fit(ef, x, TARGETS)
    pred = linear.univariate_predict(ef, coef, x, TARGETS)
    return pred.select("text_id", "fold", *TARGETS, *[f"pred_{t}" for t in TARGETS])


def test_predictions(spark: SparkSession, sf: str, model: str = "chars",
                     seed: int = DEFAULT_SEED, k: int = N_FOLDS,
                     base: DataFrame | None = None) -> DataFrame:
    """Unlabelled essays scored by the mean of the k fold models: ``(text_id, t…)``."""
    x = MODELS[model]
    ef = base if base is not None else essays_folds(spark, sf, seed, k)
    coef = linear.univariate_fold_fit(ef, x, TARGETS)
    test = unlabelled_features(spark, sf)
    return linear.univariate_predict_all_folds(test, coef, x, TARGETS).select("text_id", *TARGETS)


# --------------------------------------------------------------------------
# DuckDB twins
# --------------------------------------------------------------------------

SQL_ESSAYS = """
  SELECT l.doc_id AS text_id, coalesce(d.text, '') AS full_text,
         CAST(l.quality AS DOUBLE) AS quality, CAST(l.toxic AS DOUBLE) AS toxic
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""

SQL_UNLABELLED = """
  SELECT d.doc_id AS text_id, coalesce(d.text, '') AS full_text
  FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""


def sql_features(src: str) -> str:
    return f"""
  SELECT *, ln(1 + length(full_text)) AS x_chars,
         ln(1 + 1 + length(full_text) - length(replace(full_text, chr(10), ''))) AS x_lines,
         ln(1 + len(string_split(full_text, ' '))) AS x_words
  FROM ({src})"""


def sql_fold_expr(id_col: str = "text_id", seed: int = DEFAULT_SEED, k: int = N_FOLDS,
                  strata: tuple = STRATA) -> str:
    part = f"PARTITION BY {', '.join(strata)} " if strata else ""
    return (f"CAST((row_number() OVER ({part}ORDER BY md5('{seed}:' || CAST({id_col} AS VARCHAR)),"
            f" {id_col}) - 1) % {k} AS INTEGER)")


def sql_essays_folds(seed: int = DEFAULT_SEED, k: int = N_FOLDS) -> str:
    return f"SELECT *, {sql_fold_expr(seed=seed, k=k)} AS fold FROM ({sql_features(SQL_ESSAYS)})"


def sql_coef(x: str, src: str = "ef", lam: float = 0.0) -> str:
    sums = ", ".join(f"sum({t}) AS sy_{t}, sum({x} * {t}) AS sxy_{t}" for t in TARGETS)
    tr = ", ".join(f"sum(sy_{t}) OVER () - sy_{t} AS sy_{t}, sum(sxy_{t}) OVER () - sxy_{t} AS sxy_{t}"
                   for t in TARGETS)
    spread = f"(CASE WHEN sxx - sx * sx / nullif(n, 0) > {linear.FLAT!r} * sxx THEN sxx - sx * sx / n ELSE 0 END + {float(lam)!r})"
    bs = ", ".join(f"coalesce((sxy_{t} - sx * sy_{t} / nullif(n, 0)) / nullif({spread}, 0), 0) AS b_{t}" for t in TARGETS)
    return f"""
  SELECT fold, {', '.join(f'(sy_{t} - b_{t} * sx) / nullif(n, 0) AS a_{t}, b_{t}' for t in TARGETS)}
  FROM (SELECT *, {bs} FROM (
    SELECT fold, sum(n) OVER () - n AS n, sum(sx) OVER () - sx AS sx,
           sum(sxx) OVER () - sxx AS sxx, {tr}
    FROM (SELECT fold, CAST(count(*) AS DOUBLE) AS n, sum({x}) AS sx, sum({x} * {x}) AS sxx, {sums}
          FROM {src} GROUP BY fold)))"""


def sql_oof(model: str = "chars", seed: int = DEFAULT_SEED, k: int = N_FOLDS) -> str:
    """CTE body producing ``(text_id, fold, t…, pred_t…)``."""
    x = MODELS[model]
    preds = ", ".join(f"c.a_{t} + c.b_{t} * e.{x} AS pred_{t}" for t in TARGETS)
    return f"""
  WITH ef AS ({sql_essays_folds(seed, k)}),
       coef AS ({sql_coef(x)})
  SELECT e.text_id, e.fold, {', '.join(f'e.{t}' for t in TARGETS)}, {preds}
  FROM ef e JOIN coef c ON e.fold = c.fold"""


def sql_test_predictions(model: str = "chars", seed: int = DEFAULT_SEED, k: int = N_FOLDS) -> str:
    x = MODELS[model]
    means = ", ".join(f"avg(a_{t}) AS a_{t}, avg(b_{t}) AS b_{t}" for t in TARGETS)
    preds = ", ".join(f"m.a_{t} + m.b_{t} * u.{x} AS {t}" for t in TARGETS)
    return f"""
  WITH ef AS ({sql_essays_folds(seed, k)}),
       coef AS ({sql_coef(x)}),
       m AS (SELECT {means} FROM coef),
       u AS ({sql_features(SQL_UNLABELLED)})
  SELECT u.text_id, {preds} FROM u, m"""


def sql_long(src: str, keys: str) -> str:
    """Wide OOF → long ``(keys, target, y, pred)``."""
    parts = [f"SELECT {keys}, '{t}' AS target, {t} AS y, pred_{t} AS pred FROM ({src})"
             for t in TARGETS]
    return " UNION ALL ".join(parts)
