"""Wide ridge without a Gram matrix, and feature groups from one block Gram matrix."""

import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gradewell.operators import blockgram, encoders, linear, wide


def sparse_table(spark, X, ys, k):
    rows = [(i, i % k, np.flatnonzero(X[i]).tolist(), X[i][X[i] != 0].tolist(),
             *[None if np.isnan(y[i]) else float(y[i]) for y in ys]) for i in range(len(X))]
    names = ", ".join(f"y{j} double" for j in range(len(ys)))
    return spark.createDataFrame(rows, f"id long, fold int, indices array<int>, values array<double>, {names}")


def ridge(X, y, lam):
    known = ~np.isnan(y)
    Z = np.hstack([np.ones((known.sum(), 1)), X[known]])
    pen = lam * np.eye(Z.shape[1])
    pen[0, 0] = 0
    return np.linalg.solve(Z.T @ Z + pen, Z.T @ y[known])


def test_wide_ridge_equals_the_normal_equations(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(240, 30)) * (rng.random((240, 30)) < 0.4) * rng.uniform(0.1, 20, 30)
    X[:, 7] = 0.0                                             # a column that no row has
    X[5] = 0.0                                                # a row without entries
    y0 = X @ rng.normal(size=30) + 3 + rng.normal(size=240)
    y1 = np.where(np.arange(240) % 7 == 0, np.nan, X[:, 2])
    df = sparse_table(spark, X, [y0, y1], 3).cache()
    m = wide.ridge_cells(df, ["y0", "y1"], 3, 30, lam=0.7)
    assert m.stopped_by == ["tolerance"] * 6 and m.passes <= 80
    for f in range(3):
        for t, y in enumerate([y0, y1]):
            want = ridge(X[np.arange(240) % 3 != f], y[np.arange(240) % 3 != f], 0.7)
            got = np.r_[m.intercepts[f * 2 + t], m.weights[:, f * 2 + t]]
            assert np.abs(got - want).max() < 1e-6
    rows = [(i % 3, X[i].tolist(), float(y0[i])) for i in range(240)]
    gram = linear.fold_gram(spark.createDataFrame(rows, "fold int, x array<double>, y0 double"), "x", ["y0"], d=30)
    for f, w in linear.solve_fold_ridge(gram, 30, 1, lam=0.7).items():
        assert np.abs(w[1:, 0] - m.weights[:, f * 2]).max() < 1e-6
    own = {(r["id"], r["target"]): r["pred"] for r in wide.predict_rows(df, m).collect()}
    for i in (0, 5, 100):
        cell = (i % 3) * 2
        assert abs(own[i, "y0"] - (m.intercepts[cell] + X[i] @ m.weights[:, cell])) < 1e-9
    mean = {(r["id"], r["target"]): r["pred"] for r in wide.predict_rows(df.drop("fold"), m, fold_col=None).collect()}
    assert abs(mean[9, "y1"] - np.mean([m.intercepts[c] + X[9] @ m.weights[:, c] for c in (1, 3, 5)])) < 1e-9


def test_wide_ridge_equals_the_one_feature_closed_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=90) + 5
    df = sparse_table(spark, x[:, None], [2 * x + rng.normal(size=90)], 3)
    m = wide.ridge_cells(df, ["y0"], 3, 1, lam=1.0)
    flat = df.select("fold", F.col("values")[0].alias("x"), "y0")
    for r in linear.univariate_fold_fit(flat, "x", ["y0"], lam=1.0).collect():
        assert abs(m.weights[0, r["fold"]] - r["b_y0"]) < 1e-6 and abs(m.intercepts[r["fold"]] - r["a_y0"]) < 1e-6


def test_wide_ridge_of_4000_columns_holds_no_matrix_on_the_driver(spark):
    rng = np.random.default_rng(3)
    width, n = 4000, 300
    rows = [(i, i % 2, sorted(rng.choice(width, 40, replace=False).tolist()), rng.normal(size=40).tolist(),
             float(rng.normal())) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, fold int, indices array<int>, values array<double>, y0 double").cache()
    df.count()
    tracemalloc.start()
    m = wide.ridge_cells(df, ["y0"], 2, width, lam=5.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < width * width * 8 / 8 and m.stopped_by == ["tolerance"] * 2      # a Gram matrix has 128 MB
    X = np.zeros((n, width))
    for i, _, at, v, _ in rows:
        X[i, at] = v
    y = np.array([r[-1] for r in rows])
    train = np.arange(n) % 2 != 0
    # the dual of ridge with a free intercept: n x n instead of 4000 x 4000
    Xc = X[train] - X[train].mean(0)
    w = Xc.T @ np.linalg.solve(Xc @ Xc.T + 5.0 * np.eye(train.sum()), y[train] - y[train].mean())
    assert np.abs(m.weights[:, 0] - w).max() < 1e-6


def test_wide_ridge_edge_cases(spark):
    schema = "id long, fold int, indices array<int>, values array<double>, y0 double, y1 double"
    empty = spark.createDataFrame([], schema)
    m = wide.ridge_cells(empty, ["y0", "y1"], 2, 5, lam=1.0)
    assert not m.weights.any() and m.stopped_by == ["tolerance"] * 4
    one_fold = spark.createDataFrame([(1, 0, [0], [1.0], 2.0, None), (2, 0, [], [], 4.0, None)], schema)
    m = wide.ridge_cells(one_fold, ["y0", "y1"], 2, 5, lam=1.0)
    assert m.intercepts[0] == 0.0 and abs(m.intercepts[2] + 0.5 * m.weights[0, 2] - 3.0) < 1e-12
    limit = wide.ridge_cells(sparse_table(spark, np.random.default_rng(0).normal(size=(40, 20)),
                                          [np.arange(40.0)], 2), ["y0"], 2, 20, lam=1e-3, max_passes=3)
    assert limit.stopped_by == ["passes"] * 2 and limit.passes == 3
    docs = spark.createDataFrame([(1, "a b A"), (2, None), (3, ""), (None, "b")], "doc_id long, text string")
    got = {r["id"]: (r["indices"], r["values"]) for r in wide.hashed_words(docs, "doc_id", "text", 64).collect()}
    assert got[2] == ([], []) and got[3] == ([], []) and abs(sum(v * v for v in got[1][1]) - 1) < 1e-12
    assert got[None][1] == [1.0]


WIDTHS, TARGETS, GROUPS = [3, 2, 4], ["y0", "y1"], {"a": [0], "b": [2, 0], "all": [0, 1, 2]}


def group_table(spark, n=150):
    rng = np.random.default_rng(8)
    X = rng.normal(size=(n, 9)) + 1
    Y = np.stack([X @ rng.normal(size=9) + rng.normal(size=n), X[:, 4] * 2], 1)
    folds = np.stack([np.arange(n) % 3, np.arange(n) // 5 % 3], 1)
    rows = [(i, X[i].tolist(), float(Y[i, 0]), float(Y[i, 1]), int(folds[i, 0]), int(folds[i, 1])) for i in range(n)]
    return X, Y, folds, spark.createDataFrame(rows, "id long, vec array<double>, y0 double, y1 double, f0 int, f1 int")


def columns_of(encoders):
    ends = np.cumsum([0, *WIDTHS])
    return np.concatenate([np.arange(ends[e], ends[e + 1]) for e in encoders])


def test_groups_equal_separate_fits(spark):
    X, Y, folds, df = group_table(spark)
    # rows with a null grade take no part
    df = df.unionByName(spark.createDataFrame([(999, [1.0] * 9, None, 1.0, 0, 0)], df.schema)).repartition(5)
    gram = blockgram.block_gram(df, "vec", WIDTHS, TARGETS, ["f0", "f1"], 3)
    got = {(r["group_id"], r["cv_id"], r["fold"], r["target"]): r for r in
           blockgram.solve_groups(gram, GROUPS, WIDTHS, TARGETS, 0.5).collect()}
    assert len(got) == 3 * 2 * 3 * 2
    for (g, cv, f, t), r in got.items():
        at, y, out = columns_of(GROUPS[g]), Y[:, TARGETS.index(t)], folds[:, cv] == f
        want = ridge(X[~out][:, at], y[~out], 0.5)
        assert np.abs(np.r_[r["intercept"], r["w"]] - want).max() < 1e-8
        rest = y[out] - want[0] - X[out][:, at] @ want[1:]
        assert abs(r["rmse"] - np.sqrt(np.mean(rest ** 2))) < 1e-8 and r["n"] == out.sum()


def test_group_submissions_are_means_over_seeds_and_folds(spark):
    X, Y, folds, df = group_table(spark)
    fits = blockgram.solve_groups(blockgram.block_gram(df, "vec", WIDTHS, TARGETS, ["f0", "f1"], 3),
                                  GROUPS, WIDTHS, TARGETS, 0.5).collect()
    weights = {"a": 1.0, "b": 2.0, "all": 3.0}
    got = blockgram.group_submissions(df.limit(20), "id", "vec", fits, GROUPS, WIDTHS, TARGETS, weights).toPandas()
    wide_ = {}
    for g, encoders in GROUPS.items():
        at = columns_of(encoders)
        for t, name in enumerate(TARGETS):
            single = [w[0] + X[:, at] @ w[1:] for cv in range(2) for f in range(3)
                      for w in [ridge(X[folds[:, cv] != f][:, at], Y[folds[:, cv] != f][:, t], 0.5)]]
            wide_[g, name] = np.mean(single, axis=0)
    for name in TARGETS:
        wide_["blend", name] = sum(weights[g] * wide_[g, name] for g in GROUPS) / 6.0
    assert len(got) == 20 * 4
    for r in got.itertuples():
        for name in TARGETS:
            assert abs(getattr(r, name) - wide_[r.group_id, name][r.id]) < 1e-8


def test_block_gram_is_one_scan_and_refuses_what_a_task_cannot_hold(spark):
    import pytest

    _, _, _, df = group_table(spark)
    gram = blockgram.block_gram(df, "vec", WIDTHS, TARGETS, ["f0", "f1"], 3)
    plan = gram._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1
    with pytest.raises(ValueError, match="passes"):
        blockgram.block_gram(df, "vec", [20_000], TARGETS, ["f0"], 3)
    assert isinstance(gram.limit(1).toPandas(), pd.DataFrame)


def test_encoders_are_made_once_and_see_bounded_batches(spark):
    texts = ["The cat", "the  CAT", "", None, "a longer text of words"] * 30
    df = spark.createDataFrame([(i if i % 40 else None, t) for i, t in enumerate(texts)], "doc long, body string").repartition(3)

    def checked():
        inner = encoders.hashed_units(16, 0, 5)

        def encode(batch):
            assert 0 < len(batch) <= encoders.BATCH and None not in batch
            return inner(batch)

        return encode

    rows = encoders.encoded(df, "doc", "body", {"w": checked, "c": lambda: encoders.hashed_units(8, 3)}).collect()
    assert len(rows) == 2 * len(texts) and sum(r["doc"] is None for r in rows) == 2 * 4
    by = {(r["doc"], r["encoder"]): np.array(r["vec"]) for r in rows if r["doc"] is not None}
    assert np.allclose(by[5, "w"], by[6, "w"]) and not by[2, "w"].any() and not by[3, "c"].any()
    assert np.allclose(by[4, "c"], encoders.hashed_units(8, 3)([texts[4]])[0]) and abs((by[4, "c"] ** 2).sum() - 1) < 1e-12


def test_groups_over_25_folds(spark):
    X, Y, _, df = group_table(spark, n=200)
    many = df.withColumn("f0", F.pmod(F.col("id") * 7, F.lit(25)).cast("int"))
    got = blockgram.solve_groups(blockgram.block_gram(many, "vec", WIDTHS, TARGETS, ["f0"], 25),
                                 {"all": [0, 1, 2]}, WIDTHS, TARGETS, 0.5).collect()
    assert len(got) == 25 * 2
    for r in got:
        train = np.arange(200) * 7 % 25 != r["fold"]
        want = ridge(X[train], Y[train][:, TARGETS.index(r["target"])], 0.5)
        assert np.abs(np.r_[r["intercept"], r["w"]] - want).max() < 1e-8
