"""Fits end by their own rule, report what ended them, and give predictions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewell.operators import gradient, trees


def _table(spark, X, ys, k):
    rows = [(i, i % k, X[i].tolist(), *[None if np.isnan(y[i]) else float(y[i]) for y in ys]) for i in range(len(X))]
    names = ", ".join(f"y{j} double" for j in range(len(ys)))
    return spark.createDataFrame(rows, f"id long, fold int, x array<double>, {names}")


@pytest.mark.parametrize("loss", ["squared", "smooth_l1", "eps_insensitive"])
def test_cells_end_by_tolerance_at_a_stationary_point(spark, loss):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(200, 4)) * [1, 1, 5, 0.2]
    y = X @ [1.0, -0.5, 0.2, 2.0] + 1 + rng.normal(scale=0.4, size=200)
    df = _table(spark, X, [y], 2).cache()
    m = gradient.fit_cells(df, "x", ["y0"], 2, 4, loss=loss, lam=1e-2, tol=1e-4, warm_start=False)
    assert m.stopped_by == ["tolerance"] * 2
    assert all(b <= a for a, b in zip(m.history, m.history[1:]))
    Z = np.hstack([np.ones((200, 1)), X])
    for f in range(2):
        tr = np.arange(200) % 2 != f
        grad = lambda w: Z[tr].T @ gradient.loss_and_grad(Z[tr] @ w - y[tr], loss, 0.1, 0.1)[1] / tr.sum() \
            + 1e-2 * np.r_[0, w[1:]]
        assert np.linalg.norm(grad(m.weights[:, f])) <= 1.1e-4 * np.linalg.norm(grad(np.zeros(5)))


def test_a_cell_that_reaches_the_limit_says_so(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(60, 3))
    df = _table(spark, X, [X[:, 0] * 3], 2).cache()
    m = gradient.fit_cells(df, "x", ["y0"], 2, 3, lam=1e-6, iters=2, tol=1e-9, warm_start=False)
    assert m.stopped_by == ["passes"] * 2 and m.endings()[0] == (0, "y0", "passes", 2)


def test_boosting_learns_a_step_and_stops_by_patience(spark):
    rng = np.random.default_rng(6)
    X = rng.integers(0, 8, (240, 3)).astype(float)      # fewer values than bins: cuts are exact
    y = np.where(X[:, 1] > 4, 4.0, -1.0) + rng.normal(scale=0.1, size=240)
    flat = np.full(240, 2.0)
    some = np.where(np.arange(240) % 5 == 0, np.nan, y)
    df = _table(spark, X, [y, flat, some], 2).cache()
    m = trees.boost_cells(df, "x", ["y0", "y1", "y2"], 2, "id", step_size=0.3, patience=3, max_depth=2)
    for cell in m.summary:
        if cell["target"] == "y1":                 # nothing to learn: the mean, no tree
            assert cell["n_trees"] == 0 and cell["stopped_by"] == "no_split" and cell["valid_rmse"] == 0.0
        else:
            assert cell["stopped_by"] == "patience" and cell["rounds"] == cell["n_trees"] + 3
            assert cell["valid_rmse"] < 0.3 * y.std()
    oof = trees.predict_boosted(df, m, "x", ["id", "fold"], "id long, fold int").where("target = 'y0'").collect()
    got = np.array([r.pred for r in sorted(oof, key=lambda r: r.id)])
    rmse = [np.sqrt(np.mean((got - y)[np.arange(240) % 2 == f] ** 2)) for f in range(2)]
    assert np.allclose(rmse, [c["valid_rmse"] for c in m.summary if c["target"] == "y0"])
    test = trees.predict_boosted(df, m, "x", ["id"], "id long", fold_col=None).where("target = 'y1'")
    assert test.agg(F.min("pred"), F.max("pred")).first() == (2.0, 2.0)


def test_every_tree_is_shrunk_and_the_limit_is_told(spark):
    rng = np.random.default_rng(7)
    X = rng.normal(size=(80, 2))
    y = X[:, 0] * 10
    m = trees.boost_cells(_table(spark, X, [y], 2), "x", ["y0"], 2, "id", max_rounds=1)
    assert [c["stopped_by"] for c in m.summary] == ["rounds"] * 2
    for f, cell in enumerate(m.trees):
        assert np.isclose(m.base[f], y[np.arange(80) % 2 != f].mean())
        assert all(0.01 * abs(v) < 0.011 * np.abs(y).max() * 2 for tree in cell for v in tree.value)


def test_best_split_equals_brute_force():
    rng = np.random.default_rng(8)
    bins, rest = rng.integers(0, 6, (50, 3)), rng.normal(size=50)
    sums = np.zeros((2, 3, 6))
    for row, r in zip(bins, rest):
        for j, b in enumerate(row):
            sums[:, j, b] += (r, 1)
    gain, feature, cut, left, right, n_left, n = trees.best_split(sums, np.array([0, 2]), 2.0, 5)
    assert (n_left, n) == ((bins[:, feature] <= cut).sum(), 50)
    score = lambda r: r.sum() ** 2 / (len(r) + 2.0)
    best = max((score(rest[bins[:, j] <= c]) + score(rest[bins[:, j] > c]) - score(rest), j, c)
               for j in (0, 2) for c in range(5)
               if 5 <= (bins[:, j] <= c).sum() <= 45)
    assert (feature, cut) == best[1:] and np.isclose(gain, best[0])
    below = bins[:, feature] <= cut
    assert np.isclose(left, rest[below].sum() / (below.sum() + 2)) and np.isclose(right, rest[~below].sum() / ((~below).sum() + 2))


def test_more_trees_than_are_held_between_two_writes(spark):
    rng = np.random.default_rng(9)
    X = rng.normal(size=(60, 2))
    df = _table(spark, X, [X[:, 0]], 2).cache()
    m = trees.boost_cells(df, "x", ["y0"], 2, "id", step_size=0.05, max_rounds=trees.FLUSH + 2, max_depth=1)
    oof = trees.predict_boosted(df, m, "x", ["id", "fold"], "id long, fold int").collect()
    err = {f: np.sqrt(np.mean([(r.pred - X[r.id, 0]) ** 2 for r in oof if r.fold == f])) for f in range(2)}
    assert np.allclose([err[0], err[1]], [c["valid_rmse"] for c in m.summary])


def test_an_empty_table_has_no_models(spark):
    df = _table(spark, np.zeros((0, 2)), [np.zeros(0)], 2)
    m = trees.boost_cells(df, "x", ["y0"], 2, "id")
    assert [c["n_trees"] for c in m.summary] == [0, 0]


def leaf_wise(bins, rest, features, lam, min_rows, max_leaves, max_depth=None):
    """Best-first growth with every histogram counted: ``(node, feature, cut, values)`` in order."""
    def split(rows):
        best = None
        for j in features:
            for c in range(bins[:, j].max(initial=0)):
                left = rows & (bins[:, j] <= c)
                right = rows & (bins[:, j] > c)
                if left.sum() < min_rows or right.sum() < min_rows:
                    continue
                score = lambda r: rest[r].sum() ** 2 / (r.sum() + lam)
                gain = score(left) + score(right) - score(rows)
                if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                    best = (gain, j, c, left, right, *[rest[r].sum() / (r.sum() + lam) for r in (left, right)])
        return best

    open_, out, made = [(0, 0, np.ones(len(rest), bool))], [], 1
    while made // 2 + 1 < max_leaves or made == 1:
        ranked = [(split(rows), node, depth) for node, depth, rows in open_ if max_depth is None or depth < max_depth]
        ranked = [r for r in ranked if r[0]]
        if not ranked:
            break
        (gain, j, c, left, right, a, b), node, depth = max(ranked, key=lambda r: r[0][0])
        out.append((node, j, c, a, b))
        open_ = [o for o in open_ if o[0] != node] + [(made, depth + 1, left), (made + 1, depth + 1, right)]
        made += 2
    return out


@pytest.mark.parametrize("max_leaves, max_depth", [(50, None), (6, None), (9, 3), (2, None)])
def test_leaf_wise_trees_equal_brute_force_with_half_the_rows_counted(spark, max_leaves, max_depth):
    rng = np.random.default_rng(10)
    n = 400
    X = rng.integers(0, 12, (n, 5)).astype(float)
    y = np.sin(X[:, 0]) * 3 + (X[:, 1] > 6) * X[:, 2] + rng.normal(scale=0.3, size=n)
    df = _table(spark, X, [y], 2).repartition(4).cache()
    m = trees.boost_cells(df, "x", ["y0"], 2, "id", step_size=0.5, max_rounds=3, max_leaves=max_leaves,
                          max_depth=max_depth, row_share=1.0, feature_share=1.0, min_rows=7)
    binned = trees._binned(list(X), m.edges)
    for f in range(2):
        train = np.arange(n) % 2 != f
        pred = np.full(n, y[train].mean())
        for tree in m.trees[f]:
            want = leaf_wise(binned[train], (y - pred)[train], range(5), 2.0, 7, max_leaves, max_depth)
            got = [i for i in np.argsort(tree.left, kind="stable") if tree.feature[i] >= 0]      # in the order split
            assert [(i, tree.feature[i], tree.cut[i]) for i in got] == [w[:3] for w in want]
            values = [tree.value[c] for i in got for c in (tree.left[i], tree.right[i])]
            assert np.allclose(values, [v for w in want for v in w[3:]])
            assert len(got) <= max_leaves - 1
            pred += 0.5 * tree.predict(binned)
    assert all(2 * rows <= parents for rows, parents in m.counted)
    assert bool(m.counted) == (max_leaves > 2)
