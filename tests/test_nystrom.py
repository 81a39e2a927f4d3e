"""Kernel regression by landmarks and by Fourier features against the exact kernel."""

import numpy as np
import pytest

from gradewell.operators import gradient, nystrom

N, D, GAMMA, LAM = 2000, 6, 0.25, 1e-4


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(12)
    # most rows lie in one small cloud; a few far ones decide what must be covered
    X = np.where(rng.random((N, 1)) < 0.85, rng.normal(scale=0.15, size=(N, D)), rng.normal(scale=1.2, size=(N, D)))
    y = np.sin(2 * X[:, 0]) + X[:, 1] * X[:, 2] + np.cos(X[:, 3] - X[:, 4]) + rng.normal(scale=0.05, size=N)
    rows = [(i, i % 2, X[i].tolist(), float(y[i])) for i in range(N)]
    return X, y, spark.createDataFrame(rows, "id long, fold int, x array<double>, y0 double").repartition(4).cache()


def held_out_rmse(X, y, fmap, train):
    Z = fmap(X)
    Z = np.hstack([np.ones((N, 1)), Z])
    pen = LAM * train.sum() * np.eye(Z.shape[1])
    pen[0, 0] = 0
    w = np.linalg.solve(Z[train].T @ Z[train] + pen, Z[train].T @ y[train])
    return float(np.sqrt(np.mean((Z[~train] @ w - y[~train]) ** 2)))


def test_landmarks_come_close_to_the_exact_kernel_and_beat_fourier_features(data):
    X, y, df = data
    train = np.arange(N) % 2 == 0
    K = nystrom.rbf(X[train], X[train], GAMMA)
    a = np.linalg.solve(K + LAM * train.sum() * np.eye(train.sum()), y[train] - y[train].mean())
    exact = np.sqrt(np.mean((nystrom.rbf(X[~train], X[train], GAMMA) @ a + y[train].mean() - y[~train]) ** 2))
    m = 128
    landmarks = nystrom.draw(df.where("fold = 0"), "x", "id", m, GAMMA, seed=3)
    fourier = gradient.FourierFeatures.draw(D, m, GAMMA, seed=3)
    by_landmarks, by_fourier = (held_out_rmse(X, y, f, train) for f in (landmarks, fourier))
    print(f"exact {exact:.4f}, landmarks {by_landmarks:.4f}, Fourier {by_fourier:.4f}")
    assert by_landmarks < 1.1 * exact and by_landmarks < by_fourier
    # the approximated kernel, and what rows keep of their own length with uniform landmarks
    whole = nystrom.rbf(X, X, GAMMA)
    error = lambda f: np.sqrt(np.mean((f(X) @ f(X).T - whole) ** 2))
    lost = lambda f: np.mean(1 - (f(X) ** 2).sum(1))
    uniform = nystrom.NystromFeatures.of(X[np.random.default_rng(0).permutation(N)[:m]], GAMMA)
    assert error(landmarks) < error(fourier) and lost(landmarks) < lost(uniform)


def test_leverage_is_that_of_the_pilot_rows(data):
    X, _, df = data
    pilot, lam = X[:20], 0.1
    got = {r["key"]: r["leverage"] for r in nystrom.leverage(df, "x", "id", pilot, GAMMA, lam).collect()}
    for i in (0, 5, 777):
        k = nystrom.rbf(X[i:i + 1], pilot, GAMMA)[0]
        want = (1 - k @ np.linalg.solve(nystrom.rbf(pilot, pilot, GAMMA) + lam * np.eye(20), k)) / lam
        assert abs(got[i] - np.clip(want, 1e-6, 1.0)) < 1e-9
    assert len(got) == N


def test_landmarks_do_not_depend_on_partitions_and_survive_odd_rows(spark, data):
    X, _, df = data
    a, b = (nystrom.draw(t, "x", "id", 40, GAMMA, seed=5) for t in (df.repartition(3), df.repartition(11)))
    assert np.array_equal(a.landmarks, b.landmarks) and len(np.unique(a.landmarks, axis=0)) == 40
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)] + [(None, None)], "id long, x array<double>")
    f = nystrom.draw(same, "x", "id", 5, 1.0, seed=1)          # repeated rows span one dimension
    assert f.out_dim(2) == 1 and np.allclose(f(np.array([[1.0, 2.0]])) ** 2, 1.0)
    with pytest.raises(ValueError, match="no row"):
        nystrom.draw(same.limit(0), "x", "id", 5, 1.0, seed=1)


def test_cells_fit_on_landmarks(data):
    X, y, df = data
    fmap = nystrom.draw(df, "x", "id", 64, GAMMA, seed=3)
    m = gradient.fit_cells(df, "x", ["y0"], 2, D, fmap=fmap, loss="squared", lam=1e-3)
    for f in range(2):
        train = np.arange(N) % 2 != f
        Z = np.hstack([np.ones((N, 1)), fmap(X)])
        pen = 1e-3 * train.sum() * np.eye(Z.shape[1])
        pen[0, 0] = 0
        want = np.linalg.solve(Z[train].T @ Z[train] + pen, Z[train].T @ y[train])
        assert np.abs(m.weights[:, f] - want).max() < 1e-2
