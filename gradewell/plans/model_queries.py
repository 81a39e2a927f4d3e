"""Per-(fold, target) models: ridge, kernel-approximated SVR, linear head,
boosted trees, checkpoint scoring and ensembles, feature groups, file keys."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.config import DEFAULT_SEED, GBT_PATIENCE, N_FOLDS, SEEDS
from gradewell.functions import text as tx
from gradewell.functions import vectors as vf
from gradewell.operators import (blockgram, encoders, ensemble, features, folds as fo, gradient, linear, metrics, nystrom, scoring,
                                 trees, wide)
from gradewell.plans import common as c
from gradewell.plans.registry import query
from gradewell.session import ensure_checkpoint_dir, scratch_path
from gradewell.sources import files, tables

T = c.TARGETS
R6 = c.r6
EMB_T = ("label", "label_high")
RIDGE_LAMBDA = 1.0
WEIGHTS = {"chars": 0.5, "lines": 0.3, "words": 0.2}


def _emb_folds(spark, sf):
    """Training table ``(vec_id, x, label, label_high, fold)``, re-read by every
    pass of the iterative fits."""
    raw = tables.table(spark, sf, "embeddings")
    emb = raw.select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x"),
        F.col("label").cast("double").alias("label"),
        (F.col("label") >= 5).cast("double").alias("label_high"))
    return fo.assign_folds(emb, "vec_id", N_FOLDS, DEFAULT_SEED)


def _fold_rmse(long):
    err = metrics.error_table(long, by=("fold",))
    return err.select("fold", "target", F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))


@query("ridge_kfold", "J6", sql=lambda: f"""
WITH ef AS ({c.sql_essays_folds()}), coef AS ({c.sql_coef('x_chars', lam=RIDGE_LAMBDA)})
{' UNION ALL '.join(f"SELECT fold, '{t}' AS target, round(a_{t}, 6) AS intercept, round(b_{t}, 6) AS slope FROM coef" for t in T)}""")
def ridge_kfold(spark, sf):
    """One-feature ridge per (fold, target) from per-fold sums (train = total - fold)."""
    ef = c.essays_folds(spark, sf)
    coef = linear.univariate_fold_fit(ef, "x_chars", T, lam=RIDGE_LAMBDA)
    pairs = F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"a_{t}").alias("intercept"),
                               F.col(f"b_{t}").alias("slope")) for t in T])
    out = coef.select("fold", F.inline(pairs))
    return out.select("fold", "target", R6("intercept").alias("intercept"), R6("slope").alias("slope"))


#: Folds of the reference's longest regressor run.
MANY_FOLDS = 25


@query("ridge_kfold_25", "J6 J1", sql=lambda: f"""
WITH ef AS ({c.sql_essays_folds(k=MANY_FOLDS)}), coef AS ({c.sql_coef('x_words', lam=RIDGE_LAMBDA)})
{' UNION ALL '.join(f"SELECT fold, '{t}' AS target, round(a_{t}, 6) AS intercept, round(b_{t}, 6) AS slope FROM coef" for t in T)}""")
def ridge_kfold_25(spark, sf):
    """The one-feature ridge over 25 folds, from one pass as well."""
    ef = c.essays_folds(spark, sf, k=MANY_FOLDS)
    coef = linear.univariate_fold_fit(ef, "x_words", T, lam=RIDGE_LAMBDA)
    pairs = F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"a_{t}").alias("intercept"),
                               F.col(f"b_{t}").alias("slope")) for t in T])
    return coef.select("fold", F.inline(pairs)).select("fold", "target", R6("intercept").alias("intercept"),
                                                       R6("slope").alias("slope"))


@query("ridge_kfold_embeddings", "J6 J7")
def ridge_kfold_embeddings(spark, sf):
    """64-feature ridge for every (fold, target): per-fold Gram matrices from one
    pass, solved on the driver; out-of-fold RMSE per cell."""
    ef = _emb_folds(spark, sf).cache()
    gram = linear.fold_gram(ef, "x", EMB_T, d=64)                 # k rows of d x d
    weights = linear.solve_fold_ridge(gram, 64, len(EMB_T), lam=RIDGE_LAMBDA)
    coef = linear.coef_table(spark, weights, EMB_T)
    long = linear.predict_linear(ef.select("vec_id", "fold", "x", *EMB_T), coef, "x") \
        .select("vec_id", "fold", "target",
                F.when(F.col("target") == "label", F.col("label")).otherwise(F.col("label_high")).alias("y"),
                "pred")
    return _fold_rmse(long).select("fold", "target", R6("rmse").alias("rmse"))


def _cells_fit(train, loss, kernel):
    """Every (fold, target) cell on the stored training table, until its gradient ends it."""
    d = 64
    fmap = gradient.Identity()
    if kernel:
        gamma = gradient.feature_scale_gamma(train, "x", d)
        fmap = (nystrom.draw(train, "x", "vec_id", 256, gamma, seed=DEFAULT_SEED) if kernel == "nystrom"
                else gradient.FourierFeatures.draw(d, 256, gamma, seed=DEFAULT_SEED))
    n_train = train.count() * (N_FOLDS - 1) / N_FOLDS
    return gradient.fit_cells(train, "x", EMB_T, N_FOLDS, d, fmap=fmap, loss=loss, lam=1.0 / n_train,
                              warm_start=False)


def _stored(spark, df):
    """Lineage cut at the shared folder: the table is scanned once per pass."""
    ensure_checkpoint_dir(spark)
    return df.checkpoint()


EMB_ROWS = "vec_id long, fold int, label double, label_high double"


def _oof(pred):
    """Predictions with the grade they are about: ``(vec_id, fold, target, y, pred)``."""
    return pred.select("vec_id", "fold", "target",
                       F.when(F.col("target") == "label", F.col("label")).otherwise(F.col("label_high")).alias("y"),
                       "pred")


def _cells_rmse(spark, sf, loss, kernel):
    ef = _stored(spark, _emb_folds(spark, sf))
    model = _cells_fit(ef, loss, kernel)
    pred = gradient.predict_cells(ef, model, "x", ["vec_id", "fold", *EMB_T], EMB_ROWS)
    endings = spark.createDataFrame(model.endings(), "fold int, target string, stopped_by string, passes int")
    return _fold_rmse(_oof(pred)).join(F.broadcast(endings), ["fold", "target"]).select(
        "fold", "target", R6("rmse").alias("rmse"), "stopped_by")


@query("svr_rff_kfold", "J3 J7 C10")
def svr_rff_kfold(spark, sf):
    """SVR(C=1) re-aimed: RBF kernel via 256 random Fourier features, smoothed
    epsilon-insensitive loss, every fold x target cell fitted in the same passes."""
    return _cells_rmse(spark, sf, "eps_insensitive", True)


@query("svr_nystrom_kfold", "J3 J7 C10")
def svr_nystrom_kfold(spark, sf):
    """The same regression on 256 landmarks drawn by leverage instead of Fourier features."""
    return _cells_rmse(spark, sf, "eps_insensitive", "nystrom")


@query("linear_head_fit", "J5")
def linear_head_fit(spark, sf):
    """Multi-target linear head on frozen vectors with Smooth-L1 loss."""
    return _cells_rmse(spark, sf, "smooth_l1", False)


#: Twenty times the default step and a twentieth of the default patience: the same
#: way without a better error ends a cell, in a twentieth of the passes.
BOOSTING = {"step_size": 20 * trees.STEP_SIZE, "patience": GBT_PATIENCE // 20, "max_leaves": 8, "max_depth": 4,
            "bins": 16}


@query("gbt_kfold", "J4 E5 E7")
def gbt_kfold(spark, sf):
    """Boosted trees per (fold, target), each ended by patience on its held-out fold."""
    model = trees.boost_cells(_emb_folds(spark, sf), "x", EMB_T, N_FOLDS, "vec_id", **BOOSTING)
    out = spark.createDataFrame(model.summary, "fold int, target string, n_trees int, rounds int, "
                                               "stopped_by string, valid_rmse double")
    return out.withColumn("valid_rmse", R6("valid_rmse"))


def _aside(spark, sf):
    """Training rows with folds, and a fifth of the ids set aside as test rows."""
    folds = _stored(spark, _emb_folds(spark, sf))
    test = F.conv(F.substring(F.md5(F.concat(F.lit("test:"), F.col("vec_id").cast("string"))), 1, 6), 16, 10)
    test = F.coalesce(test.cast("long") % 5 == 0, F.lit(False))
    return folds.where(~test), folds.where(test)


def _product(oof, test):
    """Out-of-fold rows of the training part and fold-mean rows of the test part."""
    columns = ["vec_id", F.col("target"), R6("pred").alias("pred")]
    return (oof.select(F.lit("oof").alias("part"), "fold", *columns)
            .unionByName(test.select(F.lit("test").alias("part"), F.lit(None).cast("int").alias("fold"), *columns)))


def _cell_predictions(spark, sf, loss, kernel):
    train, test = _aside(spark, sf)
    model = _cells_fit(train, loss, kernel)
    return _product(gradient.predict_cells(train, model, "x", ["vec_id", "fold"], "vec_id long, fold int"),
                    gradient.predict_cells(test, model, "x", ["vec_id"], "vec_id long", fold_col=None))


@query("svr_predictions", "J3 J7 J8")
def svr_predictions(spark, sf):
    """Out-of-fold rows and fold-mean test rows of the kernel-approximated SVR."""
    return _cell_predictions(spark, sf, "eps_insensitive", True)


@query("linear_head_predictions", "J5 J7 J8")
def linear_head_predictions(spark, sf):
    """Out-of-fold rows and fold-mean test rows of the Smooth-L1 head."""
    return _cell_predictions(spark, sf, "smooth_l1", False)


@query("gbt_predictions", "J4 J7 J8")
def gbt_predictions(spark, sf):
    """Out-of-fold rows and fold-mean test rows of the boosted trees."""
    train, test = _aside(spark, sf)
    model = trees.boost_cells(train, "x", EMB_T, N_FOLDS, "vec_id", **BOOSTING)
    return _product(trees.predict_boosted(train, model, "x", ["vec_id", "fold"], "vec_id long, fold int"),
                    trees.predict_boosted(test, model, "x", ["vec_id"], "vec_id long", fold_col=None))


# ---------------------------------------------------------------- checkpoints

def _family_rows(spark, sf):
    """Checkpoint rows (model, fold, target, intercept, slope, feature) of the three
    baseline families, before they are saved."""
    base = c.essays_folds(spark, sf).cache()
    frames = []
    for m, x in c.MODELS.items():
        coef = linear.univariate_fold_fit(base, x, T)
        pairs = F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"a_{t}").alias("intercept"),
                                   F.col(f"b_{t}").alias("slope")) for t in T])
        frames.append(coef.select(F.lit("baseline").alias("run"), F.lit(0).alias("cv_id"),
                                  F.lit(m).alias("model"), F.lit(x).alias("feature"), "fold",
                                  F.inline(pairs)))
    return reduce(DataFrame.unionByName, frames)


def _checkpoints(spark, sf):
    """The families' models saved to the registry and loaded back."""
    path = scratch_path(spark, "registry")
    files.registry_save(_family_rows(spark, sf), path)
    loaded = files.registry_load(spark, path, "baseline")
    return [r.asDict() for r in loaded.collect()]   # families x folds x targets rows


def _scored(spark, sf):
    docs = c.unlabelled_features(spark, sf)
    return scoring.score_checkpoints(docs, _checkpoints(spark, sf), list(c.MODELS.values()))


def _sql_checkpoint_preds() -> str:
    parts = []
    for m, x in c.MODELS.items():
        for t in T:
            parts.append(f"""SELECT u.text_id, '{m}' AS model, c.fold, '{t}' AS target,
                                    c.a_{t} + c.b_{t} * u.{x} AS pred
                             FROM u, ({c.sql_coef(x)}) c""")
    return f"""WITH ef AS ({c.sql_essays_folds()}), u AS ({c.sql_features(c.SQL_UNLABELLED)})
               {' UNION ALL '.join(parts)}"""


@query("batch_scoring", "J9 J10 J14 K3 K6 A7", sql=lambda: f"""
SELECT text_id, model, fold, target, round(pred, 6) AS pred FROM ({_sql_checkpoint_preds()})""")
def batch_scoring(spark, sf):
    s = _scored(spark, sf)
    return s.select("text_id", "model", "fold", "target", R6("pred").alias("pred"))


@query("registry_scoring", "A7 J9 J10", sql=lambda: f"""
SELECT text_id, model, fold, target, round(pred, 6) AS pred FROM ({_sql_checkpoint_preds()})""")
def registry_scoring(spark, sf):
    """The registry saved model by model, as folds end, a first version of every model of
    fold 0 among them; loading gives each (model, fold, target) as it was saved last."""
    path = scratch_path(spark, "registry")
    rows = _kept(spark, _family_rows(spark, sf), "registry-rows")
    files.registry_save(rows.where("fold = 0").withColumn("intercept", F.lit(-1.0)), path)
    for fold in range(N_FOLDS):
        for t in T:
            files.registry_save(rows.where((F.col("fold") == fold) & (F.col("target") == t)), path)
    loaded = files.registry_load(spark, path, "baseline")
    models = [r.asDict() for r in loaded.collect()]       # families x folds x targets rows
    s = scoring.score_checkpoints(c.unlabelled_features(spark, sf), models, list(c.MODELS.values()))
    return s.select("text_id", "model", "fold", "target", R6("pred").alias("pred"))


@query("checkpoint_ensemble", "J8 J10 D8 D9 J17", sql=lambda: f"""
WITH p AS (SELECT text_id, model, target, avg(pred) AS pred FROM ({_sql_checkpoint_preds()}) GROUP BY 1, 2, 3),
     w AS ({' UNION ALL '.join(f"SELECT '{m}' AS model, {w} AS w" for m, w in WEIGHTS.items())}),
     b AS (SELECT p.text_id, p.target, sum(w.w * p.pred) / sum(w.w) AS v FROM p JOIN w ON p.model = w.model GROUP BY 1, 2)
SELECT text_id, {', '.join(f"round(max(v) FILTER (WHERE target = '{t}'), 6) AS {t}" for t in T)}
FROM b GROUP BY text_id""")
def checkpoint_ensemble(spark, sf):
    """Mean over each family's fold checkpoints, weighted blend of families,
    pivoted into the submission's target columns."""
    s = _scored(spark, sf)
    fam = s.groupBy("text_id", "model", "target").agg(F.avg("pred").alias("pred"))
    wide = fam.groupBy("text_id", "model").pivot("target", list(T)).agg(F.first("pred"))
    weights = spark.createDataFrame(list(WEIGHTS.items()), "model string, w double")
    out = ensemble.weighted_blend(wide, weights, "text_id", T)
    return out.select("text_id", *[R6(t).alias(t) for t in T])


# ---------------------------------------------------------------- wide features

WIDE = 4096


def _wide_rows(spark, sf):
    """``(text_id, indices, values, fold, quality, toxic)``: hashed words of the labelled
    essays, and the same without fold for the unlabelled ones."""
    docs = tables.table(spark, sf, "documents")
    encoded = wide.hashed_words(docs, "doc_id", "text", WIDE).withColumnRenamed("id", "text_id")
    encoded = _kept(spark, encoded, "wide")
    folds = fo.assign_folds(c.labelled(spark, sf), "text_id", N_FOLDS, DEFAULT_SEED, strata=c.STRATA)
    return _kept(spark, folds.join(encoded, "text_id"), "wide-folds"), folds, encoded


def _kept(spark, df, name):
    """A table of the shared folder that every pass reads again."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


@query("ridge_wide_kfold", "J6 J7")
def ridge_wide_kfold(spark, sf):
    """Ridge on 4,096 hashed word columns for every (fold, target), by conjugate gradients
    over passes: no Gram matrix anywhere. Held-out RMSE of each cell."""
    rows, _, _ = _wide_rows(spark, sf)
    model = wide.ridge_cells(rows, T, N_FOLDS, WIDE, RIDGE_LAMBDA)
    long = wide.predict_rows(rows, model, keep=["fold", *T])
    y = F.when(F.col("target") == T[0], F.col(T[0])).otherwise(F.col(T[1]))
    endings = model.table(spark).select("fold", "target", "stopped_by")
    return _fold_rmse(long.withColumn("y", y)).join(F.broadcast(endings), ["fold", "target"]).select(
        "fold", "target", R6("rmse").alias("rmse"), "stopped_by")


@query("ridge_wide_predictions", "J6 J7 J8")
def ridge_wide_predictions(spark, sf):
    """Out-of-fold rows of the labelled essays and fold-mean rows of the others."""
    rows, folds, encoded = _wide_rows(spark, sf)
    model = wide.ridge_cells(rows, T, N_FOLDS, WIDE, RIDGE_LAMBDA)
    columns = ["text_id", "target", R6("pred").alias("pred")]
    test = wide.predict_rows(encoded.join(folds.select("text_id"), "text_id", "left_anti"), model, fold_col=None, keep=["text_id"])
    return (wide.predict_rows(rows, model, keep=["text_id", "fold"]).select(F.lit("oof").alias("part"), "fold", *columns)
            .unionByName(test.select(F.lit("test").alias("part"), F.lit(None).cast("int").alias("fold"), *columns)))


# ---------------------------------------------------------------- feature groups

#: Four encoders (blocks of the stored vectors) and the groups that are fitted of them.
ENCODERS = [16, 16, 16, 16]
GROUPS = {"g_low": [0, 1], "g_high": [2, 3], "g_all": [0, 1, 2, 3]}
GROUP_WEIGHTS = {"g_low": 1.0, "g_high": 1.0, "g_all": 2.0}


def _encoder_blocks(spark, sf):
    """``(vec_id, vec)``: the encoders' unit vectors, computed where the feature store has
    none yet, and put side by side."""
    emb = tables.table(spark, sf, "embeddings")
    wanted = spark.createDataFrame([(b,) for b in range(len(ENCODERS))], "block int")
    store = scratch_path(spark, "feature-store")

    def compute(missing):
        blocks = emb.select("vec_id", F.col("embedding").cast("array<double>").alias("e")) \
            .select("vec_id", F.inline(F.array(*[
                F.struct(F.lit(b).alias("block"), vf.l2_normalise(F.slice("e", b * 16 + 1, 16)).alias("vec"))
                for b in range(len(ENCODERS))])))
        return blocks.join(F.broadcast(missing), "block", "left_semi")

    blocks = files.feature_store_get_or_compute(spark, store, wanted, ["block"], compute)
    return features.hconcat(blocks, "vec_id", n_blocks=len(ENCODERS))


def _group_fits(spark, sf, rows):
    """Every (group, seed, fold, target) of the rows from one scan of them."""
    emb = tables.table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("double").alias("label"), (F.col("label") >= 5).cast("double").alias("label_high"))
    table = rows.join(emb, "vec_id")
    for cv, seed in enumerate(SEEDS):
        folds = fo.assign_folds(rows.select("vec_id"), "vec_id", N_FOLDS, seed)
        table = table.join(folds.select("vec_id", F.col("fold").alias(f"fold{cv}")), "vec_id")
    gram = blockgram.block_gram(table, "vec", ENCODERS, EMB_T, [f"fold{cv}" for cv in range(len(SEEDS))], N_FOLDS)
    return blockgram.solve_groups(_kept(spark, gram, "gram"), GROUPS, ENCODERS, EMB_T, RIDGE_LAMBDA)


@query("feature_group_runner", "A5 J11 J12 C7")
def feature_group_runner(spark, sf):
    """Feature groups (sets of encoder blocks) -> feature store -> concatenation -> one
    block Gram matrix -> k-fold ridge of each group and seed -> held-out RMSE."""
    fits = _group_fits(spark, sf, _encoder_blocks(spark, sf))
    return fits.select("group_id", "cv_id", "fold", "target", R6("rmse").alias("rmse"))


@query("feature_group_submission", "A9 J8 J11 J12 J17 D8 D9")
def feature_group_submission(spark, sf):
    """Groups over seeds and folds to submissions: a fifth of the ids set aside, scored by
    each group's mean model and by the weighted blend of groups."""
    vectors = _kept(spark, _encoder_blocks(spark, sf), "group-vectors")
    test = F.coalesce(F.pmod(F.crc32(F.col("vec_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    fits = _group_fits(spark, sf, vectors.where(~test)).collect()      # groups x seeds x folds x targets models
    out = blockgram.group_submissions(vectors.where(test), "vec_id", "vec", fits, GROUPS, ENCODERS, EMB_T, GROUP_WEIGHTS)
    return out.select("vec_id", "group_id", *[R6(t).alias(t) for t in EMB_T])


#: Encoders of texts with their widths, in the order of their vectors, and groups of them.
TEXT_ENCODERS = {"char3": (48, 3), "char5": (32, 5), "words": (64, 0)}
TEXT_GROUPS = {"chars": [0, 1], "words": [2], "all": [0, 1, 2]}


@query("encoder_groups", "A5 J11 J12 C7")
def encoder_groups(spark, sf):
    """Essays encoded by plug-in encoders into the feature store, and groups of encoders
    fitted over seeds and folds from one block Gram matrix: held-out RMSE."""
    essays = tables.essays(spark, sf)
    store = scratch_path(spark, "text-features")

    def compute(missing):
        made = {r["encoder"]: partial(encoders.hashed_units, *TEXT_ENCODERS[r["encoder"]]) for r in missing.collect()}
        return encoders.encoded(essays.select("text_id", "full_text"), "text_id", "full_text", made)

    def stored(names):
        wanted = spark.createDataFrame([(n,) for n in names], "encoder string")
        return files.feature_store_get_or_compute(spark, store, wanted, ["encoder"], compute)

    stored(["words"])                                   # an earlier run had one encoder
    vectors = features.hconcat(stored(list(TEXT_ENCODERS)), "text_id", n_blocks=len(TEXT_ENCODERS), block_col="encoder")
    table = vectors.join(c.labelled(spark, sf), "text_id")
    for cv, seed in enumerate(SEEDS):
        folds = fo.assign_folds(c.labelled(spark, sf), "text_id", N_FOLDS, seed, strata=c.STRATA)
        table = table.join(folds.select("text_id", F.col("fold").alias(f"fold{cv}")), "text_id")
    widths = [w for w, _ in TEXT_ENCODERS.values()]
    gram = blockgram.block_gram(table, "vec", widths, T, [f"fold{cv}" for cv in range(len(SEEDS))], N_FOLDS)
    fits = blockgram.solve_groups(_kept(spark, gram, "text-gram"), TEXT_GROUPS, widths, T, RIDGE_LAMBDA)
    return fits.select("group_id", "cv_id", "fold", "target", "n", R6("rmse").alias("rmse"))


# ---------------------------------------------------------------- file keys

NAME_RE = r"^(.*)_gpu(\d+)_fold(\d+)_best$"


@query("file_keys", "A6 A8 E9 G5 G6 G7", sql=lambda: f"""
WITH k AS (SELECT DISTINCT cv_id, fold FROM ({' UNION ALL '.join(
    f"SELECT {i} AS cv_id, {c.sql_fold_expr('doc_id', seed=s)} AS fold FROM labels" for i, s in enumerate(SEEDS))})),
     m AS ({' UNION ALL '.join(f"SELECT '{m}' AS model" for m in c.MODELS)}),
     p AS (SELECT '/models/' || m.model || '/' || printf('%s_gpu%d_fold%d_best', m.model, k.cv_id, k.fold) || '.pth' AS path
           FROM k, m),
     s AS (SELECT path, regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') AS stem FROM p)
SELECT path, stem, regexp_extract(stem, '{NAME_RE}', 1) AS model,
       CASE WHEN CAST(regexp_extract(stem, '{NAME_RE}', 2) AS INTEGER) = 0 THEN {SEEDS[0]} ELSE {SEEDS[1]} END AS seed,
       CAST(regexp_extract(stem, '{NAME_RE}', 3) AS INTEGER) AS fold
FROM s""")
def file_keys(spark, sf):
    """Checkpoint-style artefact names formatted from the fold table, then the
    (model, seed, fold) keys parsed back from the paths; one path per key."""
    lab = tables.table(spark, sf, "labels").select(F.col("doc_id").alias("text_id"), "quality", "toxic")
    keys = fo.repeated_folds(lab, "text_id", N_FOLDS, SEEDS, strata=c.STRATA).select("cv_id", "fold").distinct()
    names = keys.withColumn("model", F.explode(F.array(*[F.lit(m) for m in c.MODELS])))
    path = F.concat(F.lit("/models/"), F.col("model"), F.lit("/"),
                    F.format_string("%s_gpu%d_fold%d_best", F.col("model"), F.col("cv_id"), F.col("fold")),
                    F.lit(".pth"))
    found = names.select(path.alias("path"))
    stem = tx.stem(F.col("path"))
    parsed = found.select("path", stem.alias("stem")).select(
        "path", "stem", F.regexp_extract("stem", NAME_RE, 1).alias("model"),
        F.when(F.regexp_extract("stem", NAME_RE, 2).cast("int") == 0, F.lit(SEEDS[0]))
        .otherwise(F.lit(SEEDS[1])).alias("seed"),
        F.regexp_extract("stem", NAME_RE, 3).cast("int").alias("fold"))
    unique = files.unique_match(parsed, ["model", "seed", "fold"])
    return unique.join(parsed.select("path", "stem"), "path").select("path", "stem", "model", "seed", "fold")
