"""Property and algorithm checks."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from gradewell.operators import containment, folds, gradient, linear, rowindex
from gradewell.plans import common as c
from gradewell.sources import tables


def test_row_index_matches_row_number_and_ignores_partitioning(spark):
    df = spark.range(0, 5000).select(F.col("id"), (F.col("id") % 7).alias("s"),
                                     F.md5(F.col("id").cast("string")).alias("h"))
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("s").orderBy("h", "id")))
    for parts in (1, 13):
        got = rowindex.global_row_index(df.repartition(parts), ["h", "id"], strata=["s"],
                                        bucket=rowindex.hex_bucket("h", 2))
        assert got.select("id", "rn").exceptAll(ref.select("id", "rn")).count() == 0
        assert got.count() == 5000


def test_bucketed_running_matches_window(spark):
    df = spark.range(0, 3000).select(F.col("id"), (F.col("id") % 5).alias("k"),
                                     (F.col("id") * 7 % 101).cast("double").alias("v"),
                                     (F.col("id") / 97).cast("long").alias("b"))
    got = rowindex.bucketed_running(df, ["k"], ["id"], "b", {"s": ("sum", "v"), "m": ("min", "v")})
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.select("id", F.sum("v").over(w).alias("s"), F.min("v").over(w).alias("m"))
    assert got.select("id", "s", "m").exceptAll(ref).count() == 0


def test_folds_partition_and_balance(spark):
    lab = tables.table(spark, SF_MID, "labels").select(F.col("doc_id").alias("text_id"), "quality", "toxic")
    f = folds.assign_folds(lab, "text_id", 4, 2022, strata=["quality", "toxic"]).cache()
    assert f.count() == lab.count() == f.select("text_id").distinct().count()
    per = f.groupBy("quality", "toxic", "fold").count().groupBy("quality", "toxic") \
        .agg((F.max("count") - F.min("count")).alias("spread")).collect()
    assert all(r.spread <= 1 for r in per)
    f2 = folds.assign_folds(lab.repartition(5).orderBy(F.rand(3)), "text_id", 4, 2022,
                            strata=["quality", "toxic"])
    assert f.exceptAll(f2).count() == 0


def test_iterative_folds_partition(spark):
    lab = tables.table(spark, SF_MID, "labels").select(F.col("doc_id").alias("text_id"), "quality", "toxic")
    f = folds.iterative_folds(lab, "text_id", ["quality", "toxic"], 4, 2022).cache()
    assert f.count() == lab.count() == f.select("text_id").distinct().count()
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    j = f.join(lab, "text_id").groupBy("fold").agg(F.sum("toxic").alias("t")).collect()
    ts = [r.t for r in j]
    assert max(ts) - min(ts) <= 1


def test_fold_ridge_total_minus_fold_equals_refit(spark):
    ef = c.essays_folds(spark, SF_MID).cache()
    coef = {r.fold: r for r in linear.univariate_fold_fit(ef, "x_chars", ["quality"], lam=0.0).collect()}
    pdf = ef.select("fold", "x_chars", "quality").toPandas()
    for f in range(4):
        tr = pdf[pdf.fold != f]
        b, a = np.polyfit(tr.x_chars, tr.quality, 1)
        assert coef[f].b_quality == pytest.approx(b, abs=1e-8)
        assert coef[f].a_quality == pytest.approx(a, abs=1e-8)


def test_gram_ridge_equals_numpy(spark):
    emb = tables.table(spark, SF_SMALL, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("y"))
    ef = folds.assign_folds(emb, "vec_id", 4, 1).cache()
    gram = linear.fold_gram(ef, "x", ["y"], d=64)
    W = linear.solve_fold_ridge(gram, 64, 1, lam=0.5)
    pdf = ef.toPandas()
    X = np.stack(pdf.x.to_numpy())
    for f in range(4):
        m = pdf.fold.to_numpy() != f
        Xa = np.hstack([np.ones((m.sum(), 1)), X[m]])
        pen = 0.5 * np.eye(65)
        pen[0, 0] = 0
        ref = np.linalg.solve(Xa.T @ Xa + pen, Xa.T @ pdf.y.to_numpy()[m])
        assert np.allclose(W[f][:, 0], ref, atol=1e-8)


def test_gradient_routine_converges_to_closed_form(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(400, 5))
    y = X @ np.array([1.0, -2.0, 0.5, 0.0, 3.0]) + 0.7
    df = spark.createDataFrame([(i, int(i % 2), X[i].tolist(), float(y[i])) for i in range(400)],
                               "id long, fold int, x array<double>, y double").cache()
    cold = gradient.fit_cells(df, "x", ["y"], 2, 5, loss="squared", lam=1e-6, iters=200,
                              tol=1e-6, warm_start=False)
    warm = gradient.fit_cells(df, "x", ["y"], 2, 5, loss="squared", lam=1e-6, iters=3)
    for f in range(2):
        tr = np.array([i % 2 != f for i in range(400)])
        Xa = np.hstack([np.ones((tr.sum(), 1)), X[tr]])
        ref = np.linalg.lstsq(Xa, y[tr], rcond=None)[0]
        assert np.allclose(cold.weights[:, f], ref, atol=2e-2)
        assert np.allclose(warm.weights[:, f], ref, atol=1e-4)   # ridge warm start is the optimum


def test_gradient_objective_never_rises_at_best_point(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(300, 4))
    y = np.sign(X[:, 0]) * 2 + rng.normal(scale=0.3, size=300)
    df = spark.createDataFrame([(i, int(i % 3), X[i].tolist(), float(y[i])) for i in range(300)],
                               "id long, fold int, x array<double>, y double").cache()
    m = gradient.fit_cells(df, "x", ["y"], 3, 4, loss="eps_insensitive", lam=1e-3, iters=25,
                           warm_start=False)
    assert min(m.history) <= m.history[0]
    assert np.isfinite(m.weights).all()


def test_rff_approximates_kernel(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(150, 4))
    gamma = 0.3
    K = np.exp(-gamma * ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    errs = []
    for D in (64, 2048):
        z = gradient.FourierFeatures.draw(4, D, gamma, seed=3)(X)
        errs.append(np.abs(z @ z.T - K).mean())
    assert errs[1] < errs[0] < 0.2


def test_containment_matches_brute_force(spark):
    docs = tables.table(spark, SF_MID, "documents").select("doc_id", "text")
    items = tables.table(spark, SF_MID, "benchmark").select("item_id", "text")
    extra = spark.createDataFrame([(9001, "le"), (9002, "zzzz-not-there")], "item_id long, text string")
    pats = items.unionByName(extra)
    got = set(map(tuple, containment.contained_pairs(pats, docs, "item_id", "doc_id").collect()))
    dl = docs.collect()
    pl = pats.collect()
    brute = {(d.doc_id, p.item_id) for d in dl for p in pl if p.text in d.text}
    assert got == brute


def test_repeated_cv_pairing_equals_flat_mean():
    rng = np.random.default_rng(5)
    s = rng.uniform(size=(2, 4))
    paired = np.mean([(s[0, i] + s[1, i]) / 2 for i in range(4)])
    assert paired == pytest.approx(s.mean())


def test_blend_weight_scale_invariance(spark):
    from gradewell.operators import ensemble

    subs = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 3.0)], "model string, text_id long, g double")
    w1 = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "model string, w double")
    w2 = spark.createDataFrame([("a", 10.0), ("b", 20.0)], "model string, w double")
    a = ensemble.weighted_blend(subs, w1, "text_id", ["g"]).first().g
    b = ensemble.weighted_blend(subs, w2, "text_id", ["g"]).first().g
    assert a == pytest.approx(b)


def test_unpivot_pivot_roundtrip(spark):
    from gradewell.plans import scoring_queries as sq

    wide = sq.oof_baseline(spark, SF_SMALL)
    long = wide.unpivot(["text_id"], ["pred_quality", "pred_toxic"], "target", "p")
    back = long.groupBy("text_id").pivot("target", ["pred_quality", "pred_toxic"]).agg(F.first("p"))
    assert back.exceptAll(wide.select("text_id", "pred_quality", "pred_toxic")).count() == 0


def test_every_labelled_row_one_oof_prediction(spark):
    o = c.oof(spark, SF_MID)
    assert o.count() == o.select("text_id").distinct().count() == tables.table(spark, SF_MID, "labels").count()


def test_hot_stratum_is_split_into_buckets(spark):
    """One stratum holds a third of the rows: numbering stays exact and the
    window runs per (stratum, bucket), never over a whole stratum."""
    df = spark.range(0, 9000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50 + 1).alias("s"),
        F.md5(F.col("id").cast("string")).alias("h"))
    got = rowindex.global_row_index(df, ["h", "id"], strata=["s"], bucket=rowindex.hex_bucket("h", 2))
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("s").orderBy("h", "id")))
    assert got.select("id", "rn").exceptAll(ref.select("id", "rn")).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_gw_b" in plan.split("Window [row_number()")[1].split("\n")[0]
    hot = got.where(F.col("s") == 0).groupBy(rowindex.hex_bucket("h", 2).alias("b")).count()
    assert hot.count() > 200 and hot.agg(F.max("count")).first()[0] < 3000 / 100


def test_pooling_selector(spark):
    from gradewell.operators import pooling

    rows = [(0, 0, p, 1, [float(p), 1.0]) for p in range(3)]
    st = spark.createDataFrame(rows, "doc_id long, layer int, pos int, mask int, vec array<double>")
    assert pooling.pool(st, "mean", 0).first().vec == pytest.approx([1.0, 1.0])
    assert pooling.pool(st, "max", 0).first().vec == pytest.approx([2.0, 1.0])
    with pytest.raises(ValueError):
        pooling.pool(st, "nope", 0)


def test_block_sum_levels_agree(spark):
    from gradewell.operators import treesum

    rows = []
    for k in range(3):
        for p in range(200):
            arr = np.full(treesum.BLOCK + 10, float(p))     # two blocks per partial
            for r in treesum.blocks({"a": arr, "m": [float(p + k)]}, {"k": k}):
                r["_part"] = p
                rows.append(r)
    parts = spark.createDataFrame(rows, "k int, _name string, _blk int, _v array<double>, _part int")
    one = treesum.collect_blocks(treesum.block_sum(parts, ["k"], ["m"], n_partials=8), ["k"])
    two = treesum.collect_blocks(treesum.block_sum(parts, ["k"], ["m"], n_partials=10_000), ["k"])
    for k in range(3):
        assert np.array_equal(one[(k,)]["a"], two[(k,)]["a"])
        assert np.array_equal(one[(k,)]["m"], two[(k,)]["m"])
    assert one[(2,)]["a"].tolist() == [float(sum(range(200)))] * (treesum.BLOCK + 10)
    assert one[(2,)]["m"].tolist() == [201.0]


def test_rff_ridge_close_to_exact_kernel_ridge(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(160, 3))
    y = np.sin(X[:, 0]) + 0.5 * X[:, 1] ** 2
    gamma, lam = 0.5, 1e-2
    df = spark.createDataFrame([(i, 0 if i < 40 else 1, X[i].tolist(), float(y[i])) for i in range(160)],
                               "id long, fold int, x array<double>, y double")
    fmap = gradient.FourierFeatures.draw(3, 1000, gamma, seed=9)
    gram = linear.fold_gram(df, "x", ["y"], d=1000, fmap=fmap)
    W = linear.solve_fold_ridge(gram, 1000, 1, lam)[0]          # trained on fold 1, predicts fold 0
    Ztest = np.hstack([np.ones((40, 1)), fmap(X[:40])])
    rff_pred = (Ztest @ W)[:, 0]
    tr = X[40:]
    K = np.exp(-gamma * ((tr[:, None] - tr[None]) ** 2).sum(-1))
    ymean = y[40:].mean()
    alpha = np.linalg.solve(K + lam * np.eye(120), y[40:] - ymean)
    Ks = np.exp(-gamma * ((X[:40, None] - tr[None]) ** 2).sum(-1))
    exact = Ks @ alpha + ymean
    assert np.sqrt(np.mean((rff_pred - exact) ** 2)) < 0.15
