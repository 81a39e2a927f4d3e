"""Multi-cell linear fitting: every (fold, target) model in one data pass per
iteration.

Rows carry a fold and a feature array. The model matrix W has one column per
cell (fold f, target t); a row trains every cell whose fold differs from its
own. Each iteration broadcasts W, every partition returns one partial
(gradient, loss, count) row computed with NumPy on Arrow batches, Spark sums
the partials, and the driver takes a quasi-Newton step. Rows never reach the
driver: only (D+1) x (k*T) numbers per iteration.

Losses: squared, Smooth-L1 and a smoothed epsilon-insensitive loss (the
support-vector regression loss with its corner rounded over ``delta``).
Kernel regression is approximated with random Fourier features (Rahimi and
Recht, 2007) for the RBF kernel; results approximate, not equal, an exact SVR.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.operators.treesum import BLOCK_SCHEMA, block_sum, blocks, collect_blocks


class Identity:
    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x

    def out_dim(self, d: int) -> int:
        return d


@dataclass
class FourierFeatures:
    """z(x) = sqrt(2/D) cos(x @ omega + b), omega ~ N(0, 2*gamma), b ~ U(0, 2*pi)."""
    omega: np.ndarray
    phase: np.ndarray

    @classmethod
    def draw(cls, d: int, n_features: int, gamma: float, seed: int) -> "FourierFeatures":
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0.0, np.sqrt(2.0 * gamma), (d, n_features)),
                   rng.uniform(0.0, 2 * np.pi, n_features))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / self.omega.shape[1]) * np.cos(x @ self.omega + self.phase)

    def out_dim(self, d: int) -> int:
        return self.omega.shape[1]


def loss_and_grad(r: np.ndarray, loss: str, eps: float, delta: float):
    """Per-element loss and derivative of the residual r = pred - y."""
    if loss == "squared":
        return 0.5 * r * r, r
    a = np.abs(r)
    if loss == "smooth_l1":
        small = a < 1.0
        return np.where(small, 0.5 * r * r, a - 0.5), np.where(small, r, np.sign(r))
    if loss == "eps_insensitive":
        e = np.maximum(a - eps, 0.0)
        quad = e <= delta
        val = np.where(quad, e * e / (2 * delta), e - delta / 2)
        der = np.where(quad, e / delta, 1.0) * np.sign(r)
        return val, der
    raise ValueError(loss)


def curvature(loss: str, delta: float) -> float:
    return {"squared": 1.0, "smooth_l1": 1.0, "eps_insensitive": 1.0 / delta}[loss]


def _partials(W: np.ndarray, fmap, feature_col: str, fold_col: str, targets: Sequence[str],
              k: int, loss: str, eps: float, delta: float):
    t_n = len(targets)

    def fn(batches):
        g = np.zeros_like(W)
        lv = np.zeros(W.shape[1])
        cnt = np.zeros(W.shape[1])
        zmax = 0.0
        for pdf in batches:
            if pdf.empty:
                continue
            Z = fmap(np.stack(pdf[feature_col].to_numpy()).astype(np.float64))
            Z = np.hstack([np.ones((Z.shape[0], 1)), Z])
            zmax = max(zmax, float((Z * Z).sum(axis=1).max()))
            Y = np.tile(pdf[list(targets)].to_numpy(dtype=np.float64), k)
            folds = pdf[fold_col].to_numpy()
            M = (np.repeat(np.arange(k), t_n)[None, :] != folds[:, None]).astype(np.float64)
            R = Z @ W - Y
            val, der = loss_and_grad(R, loss, eps, delta)
            g += Z.T @ (der * M)
            lv += (val * M).sum(axis=0)
            cnt += M.sum(axis=0)
        yield pd.DataFrame(blocks({"g": g, "l": lv, "c": cnt, "z": [zmax]}),
                           columns=["_name", "_blk", "_v", "_part"])

    return fn


@dataclass
class CellModel:
    weights: np.ndarray            # (D+1) x (k*T); column f*T + t
    k: int
    targets: tuple
    fmap: object
    history: list = field(default_factory=list)
    stopped_by: list = field(default_factory=list)   # per column: tolerance, precision or passes

    def column(self, fold: int, target: str) -> int:
        return fold * len(self.targets) + self.targets.index(target)

    def endings(self) -> list[tuple[int, str, str, int]]:
        """``(fold, target, stopped_by, passes)`` of every cell."""
        return [(f, t, self.stopped_by[self.column(f, t)], len(self.history))
                for f in range(self.k) for t in self.targets]


class _Curvature:
    """The last ``size`` accepted steps of every cell (limited-memory BFGS)."""

    def __init__(self, size: int, rows: int, cols: int):
        self.s = np.zeros((size, rows, cols))
        self.y = np.zeros((size, rows, cols))
        self.rho = np.zeros((size, cols))            # 0 marks an empty place

    def push(self, step: np.ndarray, change: np.ndarray, cells: np.ndarray) -> None:
        sy = (step * change).sum(axis=0)
        norm = np.sqrt((step * step).sum(axis=0) * (change * change).sum(axis=0))
        cells = np.flatnonzero(cells & (sy > 1e-10 * norm))
        for kept, new in ((self.s, step), (self.y, change)):
            kept[:-1, :, cells] = kept[1:, :, cells]
            kept[-1, :, cells] = new[:, cells].T
        self.rho[:-1, cells] = self.rho[1:, cells]
        self.rho[-1, cells] = 1.0 / sy[cells]

    def direction(self, grad: np.ndarray, first: float) -> np.ndarray:
        q, taken = grad.copy(), []
        for s, y, rho in zip(self.s[::-1], self.y[::-1], self.rho[::-1]):
            a = rho * (s * q).sum(axis=0)
            taken.append(a)
            q -= a * y
        yy = (self.y[-1] ** 2).sum(axis=0)
        known = self.rho[-1] > 0
        q *= np.where(known, 1.0 / np.where(known, self.rho[-1] * yy, 1.0), first)
        for s, y, rho, a in zip(self.s, self.y, self.rho, taken[::-1]):
            q += s * (a - rho * (y * q).sum(axis=0))
        return -q


def fit_cells(df: DataFrame, feature_col: str, targets: Sequence[str], k: int,
              d: int, fmap=None, loss: str = "squared", lam: float = 1e-3,
              iters: int = 2000, eps: float = 0.1, delta: float = 0.1, tol: float = 1e-3,
              warm_start: bool = True, fold_col: str = "fold", memory: int = 10) -> CellModel:
    """Fit all k x T cells. ``df`` should be stored by the caller (it is scanned
    once per pass).

    Limited-memory BFGS for each cell, all cells in the same passes. A trial point
    that does not lower its cell's objective enough is retried nearer, so every
    cell's objective only falls. A cell ends when its gradient's norm is at most
    ``tol`` times the norm at zero weights. ``iters`` limits the passes;
    ``stopped_by`` tells for each cell what ended it: ``tolerance``, ``precision``
    (no lower point can be told in floating point) or ``passes`` (the limit: that
    fit is unfinished).

    With ``warm_start`` one extra pass collects each fold's Gram matrix of the
    mapped features, which the driver holds, and the passes start from the ridge
    solution. Without it the driver holds a few weight matrices only.
    """
    fmap = fmap or Identity()
    D = fmap.out_dim(d)
    cols = k * len(targets)
    data = df.select(fold_col, feature_col, *targets)
    reg = np.ones((D + 1, 1))
    reg[0] = 0.0

    def evaluate(point):
        parts = data.mapInPandas(_partials(point, fmap, feature_col, fold_col, targets, k,
                                           loss, eps, delta), BLOCK_SCHEMA)
        row = collect_blocks(block_sum(parts, [], max_names=["z"]), [])[()]
        cnt = np.maximum(np.array(row["c"]), 1.0)
        grad = np.array(row["g"]).reshape(D + 1, cols) / cnt + lam * reg * point
        obj = np.array(row["l"]) / cnt + 0.5 * lam * (reg * point * point).sum(axis=0)
        return obj, grad, row["z"][0]

    norm = lambda m: np.sqrt((m * m).sum(axis=0))
    best_W = np.zeros((D + 1, cols))
    best_obj, best_g, z_max = evaluate(best_W)
    target_norm = tol * norm(best_g)
    first = 1.0 / (curvature(loss, delta) * z_max + lam)      # 1/L: always a descent step
    history = [float(best_obj.mean())]
    if warm_start:
        from gradewell.operators.linear import fold_gram, solve_fold_ridge

        gram = fold_gram(df, feature_col, targets, D, fold_col=fold_col, fmap=fmap)
        W = np.zeros((D + 1, cols))
        for f, Wf in solve_fold_ridge(gram, D, len(targets), lam, fold_col, per_row=True).items():
            W[:, f * len(targets):(f + 1) * len(targets)] = Wf
        obj, grad, _ = evaluate(W)
        better = obj < best_obj
        best_obj = np.where(better, obj, best_obj)
        best_W, best_g = np.where(better, W, best_W), np.where(better, grad, best_g)
        history.append(float(best_obj.mean()))
    seen = _Curvature(memory, D + 1, cols)
    ended = np.where(norm(best_g) <= target_norm, "tolerance", "")
    way, size = seen.direction(best_g, first), np.ones(cols)
    while len(history) < iters and (ended == "").any():
        live = ended == ""
        slope = (best_g * way).sum(axis=0)
        step = np.where(live, size, 0.0) * way
        obj, grad, _ = evaluate(best_W + step)
        accept = live & (obj <= best_obj + 1e-4 * size * slope)
        seen.push(step, grad - best_g, accept)
        # the lowest point of the parabola through both values and the slope
        bend = obj - best_obj - size * slope
        nearer = np.where(bend > 0, -slope * size ** 2 / (2 * np.where(bend > 0, bend, 1.0)), 0.5 * size)
        best_obj = np.where(accept, obj, best_obj)
        best_W, best_g = np.where(accept, best_W + step, best_W), np.where(accept, grad, best_g)
        way = np.where(accept, seen.direction(best_g, first), way)
        size = np.where(accept, 1.0, np.clip(nearer, 0.1 * size, 0.5 * size))
        history.append(float(best_obj.mean()))
        ended = np.where(live & (norm(best_g) <= target_norm), "tolerance", ended)
        ended = np.where((ended == "") & (size < 1e-12), "precision", ended)
    return CellModel(best_W, k, tuple(targets), fmap, history, np.where(ended == "", "passes", ended).tolist())


def _predict_fn(model: CellModel, feature_col: str, fold_col: str | None, keep: Sequence[str]):
    t_n = len(model.targets)

    def fn(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            Z = model.fmap(np.stack(pdf[feature_col].to_numpy()).astype(np.float64))
            Z = np.hstack([np.ones((Z.shape[0], 1)), Z])
            P = Z @ model.weights                     # n x (k*T)
            out = []
            for j, t in enumerate(model.targets):
                if fold_col is not None:
                    f = pdf[fold_col].to_numpy().astype(int)
                    pred = P[np.arange(len(pdf)), f * t_n + j]
                else:                                 # test rows: mean of the k fold models
                    pred = P[:, j::t_n].mean(axis=1)
                part = pdf[list(keep)].copy()
                part["target"] = t
                part["pred"] = pred
                out.append(part)
            yield pd.concat(out, ignore_index=True)

    return fn


def predict_cells(df: DataFrame, model: CellModel, feature_col: str, keep: Sequence[str],
                  keep_schema: str, fold_col: str | None = "fold") -> DataFrame:
    """Long predictions ``(keep…, target, pred)``: out-of-fold when ``fold_col``
    is given, else averaged over the k fold models (J7 / J8)."""
    cols = list(keep) + [feature_col] + ([fold_col] if fold_col and fold_col not in keep else [])
    return df.select(*cols).mapInPandas(
        _predict_fn(model, feature_col, fold_col, keep),
        f"{keep_schema}, target string, pred double")


def feature_scale_gamma(df: DataFrame, feature_col: str, d: int) -> float:
    """gamma = 1 / (d * Var(X)) over all feature values (the common 'scale' default)."""
    s1 = F.aggregate(feature_col, F.lit(0.0), lambda a, x: a + x)
    s2 = F.aggregate(feature_col, F.lit(0.0), lambda a, x: a + x * x)
    r = df.agg(F.sum(s1).alias("s1"), F.sum(s2).alias("s2"),
               F.sum(F.size(feature_col)).alias("n")).first()
    var = r["s2"] / r["n"] - (r["s1"] / r["n"]) ** 2
    return 1.0 / (d * var) if var > 0 else 1.0
