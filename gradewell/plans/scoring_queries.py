"""Out-of-fold assembly, scores, losses, ensembles, submissions, pseudo labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.config import SEEDS, TEMPLATE_GRADE
from gradewell.operators import ensemble, linear, metrics, pseudo
from gradewell.plans import common as c
from gradewell.plans.registry import query
from gradewell.sources import tables

T = c.TARGETS
R6 = c.r6


def _errors(spark, sf, model="chars"):
    """(fold, target, sse, n): k x T rows, persisted because every score level
    is derived from it."""
    long = metrics.to_long(c.oof(spark, sf, model), ["text_id", "fold"], T)
    return metrics.error_table(long, by=("fold",)).persist()


# ---------------------------------------------------------------- flagship

@query("cv_scores", "J1 J6 J7 D3 D4 D5 D6", sql=lambda: f"""
WITH o AS ({c.sql_oof()}),
     l AS ({c.sql_long('SELECT * FROM o', 'text_id, fold')}),
     e AS (SELECT fold, target, sum((y - pred) * (y - pred)) AS sse, count(*) AS n
           FROM l GROUP BY fold, target),
     pf AS (SELECT fold, target, sqrt(sse / n) AS rmse FROM e
            UNION ALL
            SELECT fold, 'mcrmse', avg(sqrt(sse / n)) FROM e GROUP BY fold),
     pt AS (SELECT target, sqrt(sum(sse) / sum(n)) AS score FROM e GROUP BY target)
SELECT 'fold_mean' AS scope, target, round(avg(rmse), 6) AS score FROM pf GROUP BY target
UNION ALL SELECT 'pooled', target, round(score, 6) FROM pt
UNION ALL SELECT 'pooled', 'mcrmse', round(avg(score), 6) FROM pt""")
def cv_scores(spark, sf):
    """Fold-mean and pooled CV of the baseline model, per target and MCRMSE."""
    return metrics.cv_scores(_errors(spark, sf)).select("scope", "target", R6("score").alias("score"))


@query("oof_baseline", "J7 F2 B10", sql=lambda: f"""
SELECT text_id, fold, {', '.join(T)}, {', '.join(f'round(pred_{t}, 6) AS pred_{t}' for t in T)}
FROM ({c.sql_oof()})""")
def oof_baseline(spark, sf):
    o = c.oof(spark, sf)
    return o.select("text_id", "fold", *T, *[R6(f"pred_{t}").alias(f"pred_{t}") for t in T])


@query("mcrmse_by_fold", "D3 D4 D5", sql=lambda: f"""
WITH o AS ({c.sql_oof()}),
     r AS (SELECT fold, {', '.join(f'sqrt(avg((pred_{t} - {t}) * (pred_{t} - {t}))) AS rmse_{t}' for t in T)}
           FROM o GROUP BY fold)
SELECT fold, {', '.join(f'round(rmse_{t}, 6) AS rmse_{t}' for t in T)},
       round(({' + '.join(f'rmse_{t}' for t in T)}) / {len(T)}, 6) AS mcrmse FROM r""")
def mcrmse_by_fold(spark, sf):
    w = metrics.mcrmse_wide(_errors(spark, sf), T)
    return w.select("fold", *[R6(f"rmse_{t}").alias(f"rmse_{t}") for t in T], R6("mcrmse").alias("mcrmse"))


def _sql_pooled_mcrmse(model: str) -> str:
    o = c.sql_oof(model)
    parts = " + ".join(f"sqrt(avg((pred_{t} - {t}) * (pred_{t} - {t})))" for t in T)
    return f"SELECT '{model}' AS model, ({parts}) / {len(T)} AS score FROM ({o})"


@query("model_leaderboard", "D6 D16", sql=lambda: f"""
WITH s AS ({' UNION ALL '.join(_sql_pooled_mcrmse(m) for m in c.MODELS)})
SELECT model, round(score, 6) AS mcrmse,
       CAST(row_number() OVER (ORDER BY score, model) AS INTEGER) AS rank FROM s""")
def model_leaderboard(spark, sf):
    board = ensemble.rank_models(_pooled_scores(spark, sf), "score")
    return board.select("model", R6("score").alias("mcrmse"), "rank")


def _pooled_scores(spark, sf):
    """``(model, score)``: pooled OOF MCRMSE of every baseline model, one pass per model."""
    base = c.essays_folds(spark, sf).cache()
    frames = [metrics.to_long(c.oof(spark, sf, m, base=base), ["text_id", "fold"], T)
              .withColumn("model", F.lit(m)) for m in c.MODELS]
    allm = frames[0]
    for f in frames[1:]:
        allm = allm.unionByName(f)
    err = metrics.error_table(allm, by=("model", "fold")).persist()
    cv = metrics.cv_scores(err, group=("model",)).where(
        (F.col("scope") == "pooled") & (F.col("target") == "mcrmse"))
    return cv.select("model", "score")


@query("loss_smooth_l1", "D12 G14", sql=lambda: f"""
SELECT target, round(avg(CASE WHEN abs(y - pred) < 1 THEN 0.5 * (y - pred) * (y - pred)
                        ELSE abs(y - pred) - 0.5 END), 6) AS smooth_l1
FROM ({c.sql_long(c.sql_oof(), 'text_id, fold')}) GROUP BY target""")
def loss_smooth_l1(spark, sf):
    long = metrics.to_long(c.oof(spark, sf), ["text_id", "fold"], T)
    return metrics.loss_table(long).select("target", R6("smooth_l1").alias("smooth_l1"))


@query("loss_root_se", "D13 G14", sql=lambda: f"""
SELECT target, round(sum(sqrt((y - pred) * (y - pred) + 1e-9)), 6) AS root_se_sum,
       round(avg(sqrt((y - pred) * (y - pred) + 1e-9)), 6) AS root_se_mean
FROM ({c.sql_long(c.sql_oof(), 'text_id, fold')}) GROUP BY target""")
def loss_root_se(spark, sf):
    long = metrics.to_long(c.oof(spark, sf), ["text_id", "fold"], T)
    return metrics.loss_table(long).select(
        "target", R6("root_se_sum").alias("root_se_sum"), R6("root_se_mean").alias("root_se_mean"))


@query("targets_long", "B14", sql=lambda: " UNION ALL ".join(
    f"SELECT text_id, '{t}' AS target, {t} AS y FROM ({c.SQL_ESSAYS})" for t in T))
def targets_long(spark, sf):
    ess = tables.essays(spark, sf)
    return ess.unpivot("text_id", list(T), "target", "y")


@query("targets_wide", "B14 B10", sql=lambda: f"""
SELECT text_id, {', '.join(f'round(pred_{t}, 6) AS pred_{t}' for t in T)} FROM ({c.sql_oof()})""")
def targets_wide(spark, sf):
    """Long OOF predictions pivoted back to ``pred_<target>`` columns."""
    long = metrics.to_long(c.oof(spark, sf), ["text_id"], T)
    wide = long.groupBy("text_id").pivot("target", list(T)).agg(F.first("pred"))
    return wide.select("text_id", *[R6(t).alias(f"pred_{t}") for t in T])


# ---------------------------------------------------------------- ensembles

WEIGHTS = {"chars": 0.5, "lines": 0.3, "words": 0.2}


def _submissions(spark, sf):
    """``(text_id, model, t…)``: every model family scores the unlabelled essays
    in one scan; each family's fold-mean coefficients arrive as a scalar subquery."""
    base = c.essays_folds(spark, sf)
    test = c.unlabelled_features(spark, sf)
    per_model = []
    for m, x in c.MODELS.items():
        coef = linear.mean_coefficients(linear.univariate_fold_fit(base, x, T), T)
        per_model.append(F.struct(F.lit(m).alias("model"), *[
            (coef.getField(f"a_{t}") + coef.getField(f"b_{t}") * F.col(x)).alias(t) for t in T]))
    return test.select("text_id", F.inline(F.array(*per_model)))


def _sql_submissions() -> str:
    return " UNION ALL ".join(
        f"SELECT '{m}' AS model, * FROM ({c.sql_test_predictions(m)})" for m in c.MODELS)


@query("ensemble_mean", "C5 D8 J17", sql=lambda: f"""
SELECT text_id, {', '.join(f'round(avg({t}), 6) AS {t}' for t in T)}
FROM ({_sql_submissions()}) GROUP BY text_id""")
def ensemble_mean(spark, sf):
    out = ensemble.keyed_mean(_submissions(spark, sf), "text_id", T)
    return out.select("text_id", *[R6(t).alias(t) for t in T])


def _sql_weights() -> str:
    return " UNION ALL ".join(f"SELECT '{m}' AS model, {w} AS w" for m, w in WEIGHTS.items())


@query("ensemble_weighted", "C5 D9 J17", sql=lambda: f"""
SELECT s.text_id, {', '.join(f'round(sum(w.w * s.{t}) / sum(w.w), 6) AS {t}' for t in T)}
FROM ({_sql_submissions()}) s JOIN ({_sql_weights()}) w ON s.model = w.model GROUP BY s.text_id""")
def ensemble_weighted(spark, sf):
    weights = spark.createDataFrame(list(WEIGHTS.items()), "model string, w double")
    out = ensemble.weighted_blend(_submissions(spark, sf), weights, "text_id", T)
    return out.select("text_id", *[R6(t).alias(t) for t in T])


@query("ensemble_inverse_score", "D5 D9 D11", sql=lambda: f"""
WITH sc AS (SELECT *, coalesce(CASE WHEN (min(score) OVER ()) = 0 THEN CAST(score = 0 AS DOUBLE)
                                    ELSE 1 / nullif(score, 0) END, 0) AS w
            FROM ({' UNION ALL '.join(_sql_pooled_mcrmse(m) for m in c.MODELS)}))
SELECT s.text_id, {', '.join(f'round(sum(s.{t} * sc.w) / nullif(sum(sc.w), 0), 6) AS {t}' for t in T)}
FROM ({_sql_submissions()}) s JOIN sc ON s.model = sc.model GROUP BY s.text_id""")
def ensemble_inverse_score(spark, sf):
    """Blend weights 1/score with score = each model's pooled OOF MCRMSE."""
    weights = ensemble.inverse_weights(_pooled_scores(spark, sf))
    out = ensemble.weighted_blend(_submissions(spark, sf), weights, "text_id", T)
    return out.select("text_id", *[R6(t).alias(t) for t in T])


@query("repeated_cv_mean", "J2 D10", sql=lambda: f"""
WITH o AS ({' UNION ALL '.join(f'SELECT {i} AS cv_id, * FROM ({c.sql_oof(seed=s)})' for i, s in enumerate(SEEDS))}),
     f AS (SELECT cv_id, fold, ({' + '.join(f'sqrt(avg((pred_{t} - {t}) * (pred_{t} - {t})))' for t in T)}) / {len(T)} AS s
           FROM o GROUP BY cv_id, fold)
SELECT o.text_id, {', '.join(f'round(avg(o.pred_{t}), 6) AS pred_{t}' for t in T)},
       round((SELECT avg(s) FROM f), 6) AS cv_mean
FROM o GROUP BY o.text_id""")
def repeated_cv_mean(spark, sf):
    """Two CVs (one per seed): OOF predictions averaged per essay, and the mean
    of all cv x fold scores (equal to pairing fold i of each seed, then averaging)."""
    oofs = None
    for i, s in enumerate(SEEDS):
        o = c.oof(spark, sf, seed=s).withColumn("cv_id", F.lit(i))
        oofs = o if oofs is None else oofs.unionByName(o)
    oofs = oofs.cache()
    err = metrics.error_table(metrics.to_long(oofs, ["cv_id", "text_id", "fold"], T),
                              by=("cv_id", "fold"))
    cv = metrics.rmse_by_fold(err, group=("cv_id",)).where(F.col("target") == "mcrmse") \
        .agg(F.avg("rmse")).scalar()
    preds = oofs.groupBy("text_id").agg(*[F.avg(f"pred_{t}").alias(f"pred_{t}") for t in T])
    return preds.select("text_id", *[R6(f"pred_{t}").alias(f"pred_{t}") for t in T], R6(cv).alias("cv_mean"))


# ---------------------------------------------------------------- submissions

@query("submission_left_join", "C1 B6 B9 A9 C9", sql=lambda: f"""
WITH tmpl AS (SELECT text_id, {', '.join(f'{TEMPLATE_GRADE} AS {t}' for t in T)} FROM ({c.SQL_UNLABELLED})),
     p AS ({c.sql_test_predictions()})
SELECT t.text_id, {', '.join(f'round(p.{t}, 6) AS {t}' for t in T)}
FROM tmpl t LEFT JOIN p ON t.text_id = p.text_id""")
def submission_left_join(spark, sf):
    """Template (all unlabelled ids, constant grades) with its grades dropped,
    left-joined to the model predictions on ``text_id``; missing stay NULL."""
    template = tables.unlabelled(spark, sf).select(
        "text_id", *[F.lit(TEMPLATE_GRADE).alias(t) for t in T])
    preds = c.test_predictions(spark, sf)
    out = ensemble.fill_template(template, preds, "text_id", T)
    return out.select("text_id", *[R6(t).alias(t) for t in T])


def _sql_pseudo(seed: int) -> str:
    """One seed's augmented splits, texts included."""
    return f"""
SELECT * FROM (
  WITH ef AS ({c.sql_essays_folds(seed=seed)}),
       coef AS ({c.sql_coef('x_chars')}),
       u AS ({c.sql_features(c.SQL_UNLABELLED)})
  SELECT 'chars' AS model, {seed} AS seed, s.fold, ef.text_id, 'train' AS role,
         {', '.join(f'ef.{t} AS {t}' for t in T)}, ef.full_text
  FROM ef JOIN (SELECT DISTINCT fold FROM ef) s ON ef.fold <> s.fold
  UNION ALL
  SELECT 'chars', {seed}, coef.fold, u.text_id, 'pseudo',
         {', '.join(f'round(coef.a_{t} + coef.b_{t} * u.x_chars, 6)' for t in T)}, u.full_text
  FROM u CROSS JOIN coef)"""


@query("pseudo_augment", "C2 F1 J14 J15 B1", sql=lambda: " UNION ALL ".join(map(_sql_pseudo, SEEDS)))
def pseudo_augment(spark, sf):
    """Keyed (model, seed, fold): the training part of every fold with its texts, plus the
    pool's texts labelled by the same key's model."""
    texts = tables.table(spark, sf, "documents").select(
        F.col("doc_id").alias("text_id"), F.coalesce("text", F.lit("")).alias("full_text"))
    parts = []
    for seed in SEEDS:
        base = c.essays_folds(spark, sf, seed)
        labels = pseudo.pool_labels(base, c.unlabelled_features(spark, sf), "x_chars", T)
        train = base.select("text_id", "fold", *T).join(texts, "text_id")
        out = pseudo.augment(train, labels, texts, "fold", T, text_col="full_text")
        parts.append(out.select(F.lit("chars").alias("model"), F.lit(seed).alias("seed"), "fold", "text_id", "role",
                                *[R6(t).alias(t) for t in T], "full_text"))
    return reduce(DataFrame.unionByName, parts)


@query("stream_scoring", "J8 J9 (L2 streaming)", sql=lambda: f"""
SELECT text_id, {', '.join(f'round({t}, 6) AS {t}' for t in T)} FROM ({c.sql_test_predictions()})""")
def stream_scoring(spark, sf):
    """Unlabelled documents arriving as a file stream, anti-joined to the static
    labels and scored by the static fold-mean model (stream-static)."""
    from gradewell.streaming import meter

    docs_schema = tables.table(spark, sf, "documents").schema
    stream = spark.readStream.schema(docs_schema).option("maxFilesPerTrigger", 1) \
        .parquet(f"{sf.rstrip('/')}/documents*.parquet")
    feats = tables.text_features(F.coalesce(F.col("text"), F.lit("")))
    stream = stream.select(F.col("doc_id").alias("text_id"), *[v.alias(k) for k, v in feats.items()])
    ids = tables.table(spark, sf, "labels").select(F.col("doc_id").alias("text_id"))
    pending = stream.join(ids, "text_id", "left_anti")
    coef = linear.univariate_fold_fit(c.essays_folds(spark, sf), "x_chars", T)
    scored = meter.run_to_table(spark, meter.score_stream(pending, coef, "x_chars", T))
    return scored.select("text_id", *[R6(t).alias(t) for t in T])
