"""Feature groups from one Gram matrix in blocks.

A run fits many groups of encoders, each over several seeds and k folds. Every
such system is made of the same products, so the rows are read once: with
``Z = [1 | encoder 0 | encoder 1 | ... | targets]`` each task adds up ``Z'Z`` by
(seed, fold), cut into blocks by pairs of encoders. Spark sums the blocks; a group's
system is the blocks of its encoders, the training part is the total minus the
fold, and the held-out error follows from the fold's own blocks. Each (group, seed,
fold) is solved in a task of its own; nothing but coefficients reaches the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.operators.treesum import block_sum, blocks

#: What one task may hold of partial sums; wider runs take ``wide.ridge_cells``.
MOST_BYTES = 1 << 30
KEYS = ["cv_id", "fold", "bi", "bj"]


def block_gram(df: DataFrame, vec_col: str, widths: Sequence[int], targets: Sequence[str],
               fold_cols: Sequence[str], k: int) -> DataFrame:
    """``(cv_id, fold, bi, bj, _blk, _v)``: blocks of ``Z'Z`` over each fold's own rows.

    Block 0 is the intercept, block i + 1 encoder i of ``widths``, the last one the
    targets; ``bi <= bj``. ``fold_cols`` has a fold column for each seed (``cv_id`` is its
    place). Rows with a null target or fold take no part.
    """
    sizes = [1, *widths, len(targets)]
    ends = np.cumsum([0, *sizes])
    if len(fold_cols) * k * ends[-1] ** 2 * 8 > MOST_BYTES:
        raise ValueError(f"{ends[-1]} columns over {len(fold_cols)} x {k} folds: fit these by passes (wide.ridge_cells)")

    def fn(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            z = np.hstack([np.ones((len(pdf), 1)), np.stack(pdf[vec_col].to_numpy()).astype(np.float64),
                           pdf[list(targets)].to_numpy(np.float64)])
            for cv, col in enumerate(fold_cols):
                for fold, at in pdf.groupby(col).indices.items():
                    part = z[at].T @ z[at]
                    key = cv, int(fold)
                    sums[key] = sums[key] + part if key in sums else part
        for (cv, fold), m in sums.items():
            for i in range(len(sizes)):
                for j in range(i, len(sizes)):
                    part = m[ends[i]:ends[i + 1], ends[j]:ends[j + 1]]
                    yield pd.DataFrame(blocks({"g": part}, {"cv_id": cv, "fold": fold, "bi": i, "bj": j}),
                                       columns=[*KEYS, "_name", "_blk", "_v", "_part"])

    rows = df.select(vec_col, *targets, *fold_cols).dropna(subset=[*targets, *fold_cols])
    schema = "cv_id int, fold int, bi int, bj int, _name string, _blk int, _v array<double>, _part int"
    return block_sum(rows.mapInPandas(fn, schema), KEYS).drop("_name")


def _system(rows: pd.DataFrame, column: str, order: Sequence[int], sizes: Mapping[int, int]) -> np.ndarray:
    """The symmetric matrix of the blocks in ``order``."""
    start = dict(zip(order, np.cumsum([0, *(sizes[b] for b in order)])))
    n = sum(sizes[b] for b in order)
    out = np.zeros((n, n))
    for (i, j), part in rows.sort_values("_blk").groupby(["bi", "bj"]):
        m = np.concatenate(part[column].to_numpy()).reshape(sizes[i], sizes[j])
        a, b = start[i], start[j]
        out[a:a + sizes[i], b:b + sizes[j]] = m
        out[b:b + sizes[j], a:a + sizes[i]] = m.T
    return out


def solve_groups(gram: DataFrame, groups: Mapping[str, Sequence[int]], widths: Sequence[int],
                 targets: Sequence[str], lam: float) -> DataFrame:
    """``(group_id, cv_id, fold, target, n, rmse, intercept, w)`` of every group's ridge.

    A group lists its encoders in the order of its features. ``rmse`` is over the ``n``
    rows of the held-out fold, worked out from the fold's own blocks. The intercept is
    not penalised. Each system is put together and solved in one task, which holds two
    matrices of the group's width.
    """
    last = len(widths) + 1
    sizes = dict(enumerate([1, *widths, len(targets)]))
    orders = {g: [0, *(e + 1 for e in es), last] for g, es in groups.items()}
    need = [(g, i, j) for g, o in orders.items() for i in o for j in o if i <= j]
    spark = gram.sparkSession
    needed = spark.createDataFrame(need, "group_id string, bi int, bj int")     # groups x encoder pairs
    total = gram.groupBy("cv_id", "bi", "bj", "_blk").agg(
        vector_to_array(Summarizer.sum(array_to_vector("_v"))).alias("_total"))
    both = gram.join(total, ["cv_id", "bi", "bj", "_blk"]).join(F.broadcast(needed), ["bi", "bj"])

    def solve(key, pdf):
        group, cv, fold = key
        order = orders[group]
        own, whole = (_system(pdf, c, order, sizes) for c in ("_v", "_total"))
        t_n = len(targets)
        train, d = whole - own, len(own) - t_n
        penalty = lam * np.eye(d)
        penalty[0, 0] = 0.0
        w = np.linalg.lstsq(train[:d, :d] + penalty, train[:d, d:], rcond=None)[0]
        n = own[0, 0]
        cross, inner = own[:d, d:], own[:d, :d]
        sse = np.diag(own[d:, d:]) - 2 * (w * cross).sum(0) + (w * (inner @ w)).sum(0)
        rows = [(group, cv, fold, t, int(round(n)), float(np.sqrt(max(sse[i], 0.0) / n)), float(w[0, i]), w[1:, i].tolist())
                for i, t in enumerate(targets)]
        return pd.DataFrame(rows, columns=["group_id", "cv_id", "fold", "target", "n", "rmse", "intercept", "w"])

    return both.groupBy("group_id", "cv_id", "fold").applyInPandas(
        solve, "group_id string, cv_id int, fold int, target string, n long, rmse double, intercept double, "
               "w array<double>")


def group_submissions(test: DataFrame, key: str, vec_col: str, fits: list, groups: Mapping[str, Sequence[int]],
                      widths: Sequence[int], targets: Sequence[str], weights: Mapping[str, float]) -> DataFrame:
    """``(key, group_id, targets…)``: each group's test rows, the mean over its seeds and
    folds, and under ``blend`` the groups' weighted mean.

    ``fits`` are the collected rows of ``solve_groups``: seeds x folds x groups x targets.
    A mean of linear models is the linear model of the mean weights, and a blend of
    groups is one over all encoders, so all tables come from one pass and one product.
    """
    ends = np.cumsum([0, *widths])
    models: dict[str, dict[str, tuple[float, np.ndarray]]] = {}
    for g, encoders in groups.items():
        columns = np.concatenate([np.arange(ends[e], ends[e + 1]) for e in encoders])
        models[g] = {}
        for t in targets:
            own = [r for r in fits if r["group_id"] == g and r["target"] == t]
            full = np.zeros(ends[-1])
            np.add.at(full, columns, np.mean([r["w"] for r in own], axis=0))
            models[g][t] = float(np.mean([r["intercept"] for r in own])), full
    share = sum(weights[g] for g in groups)
    models["blend"] = {t: (sum(weights[g] * models[g][t][0] for g in groups) / share,
                           sum(weights[g] * models[g][t][1] for g in groups) / share) for t in targets}
    names = list(models)
    w = np.stack([models[g][t][1] for g in names for t in targets], axis=1)
    b = np.array([models[g][t][0] for g in names for t in targets])

    def score(batches):
        for pdf in batches:
            if len(pdf):
                z = np.stack(pdf[vec_col].to_numpy()).astype(np.float64) @ w + b
                for i, g in enumerate(names):
                    part = z[:, i * len(targets):(i + 1) * len(targets)]
                    yield pd.DataFrame({key: pdf[key].to_numpy(), "group_id": g, **{t: part[:, j] for j, t in enumerate(targets)}})

    kind = test.schema[key].dataType.simpleString()
    return test.select(key, vec_col).where(F.col(vec_col).isNotNull()).mapInPandas(
        score, f"{key} {kind}, group_id string, {', '.join(f'{t} double' for t in targets)}")
