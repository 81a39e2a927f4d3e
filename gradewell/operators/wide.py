"""Ridge over wide features without a Gram matrix.

With thousands of columns the d x d matrix of the normal equations no longer
fits where one process holds it. Conjugate gradients need products of that
matrix with a few vectors only, and such a product is one pass over the rows:
``X'(X p)``, each task adding up its rows' share. All (fold, target) cells go in
the same passes; the driver holds a handful of ``width x cells`` arrays.

Rows are sparse: ``indices`` and ``values`` of their entries that are not 0, an
index at most once in a row. ``hashed_words`` makes them from texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradewell.operators.treesum import BLOCK_SCHEMA, block_sum, blocks, collect_blocks


def hashed_words(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(id, indices, values)``: the square roots of word shares, by hash of the
    lower-cased word. An empty or null text has no entries."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[str, int] = {}                       # of words met; emptied when it grows long
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                docs = [(text or "").lower().split() for text in part.column("text").to_pylist()]
                if len(slots) > 500_000:
                    slots.clear()
                for word in set().union(*docs).difference(slots):
                    slots[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % width
                sizes = np.array([len(words) for words in docs], np.int64)
                slot = np.array([slots[w] for words in docs for w in words], np.int64)
                entry, n = np.unique(np.repeat(np.arange(len(docs)), sizes) * width + slot, return_counts=True)
                row = entry // width
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(docs)))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x))
                         for x in ((entry % width).astype(np.int32), (n / sizes[row]) ** 0.5)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *lists], ["id", "indices", "values"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encode, "id long, indices array<int>, values array<double>")


class _Rows:
    """Sparse rows of one Arrow batch, with products by dense matrices. The lists' entries
    are taken as they lie, and each cell's column is gathered and added up in one piece."""

    def __init__(self, batch: pa.RecordBatch, width: int):
        self.n, self.width = batch.num_rows, width
        lists = batch.column("indices")
        sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        self.row = np.repeat(np.arange(self.n), sizes)
        self.index = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.value = batch.column("values").flatten().to_numpy(zero_copy_only=False).astype(np.float64)

    def times(self, p: np.ndarray) -> np.ndarray:
        """``X p``"""
        columns = np.ascontiguousarray(p.T)
        return np.stack([np.bincount(self.row, self.value * column[self.index], self.n) for column in columns], 1)

    def transposed_times(self, r: np.ndarray, power: int = 1) -> np.ndarray:
        """``X' r``, or with the entries' squares"""
        v = self.value ** power if power != 1 else self.value
        columns = np.ascontiguousarray(r.T)
        return np.stack([np.bincount(self.index, v * column[self.row], self.width) for column in columns], 1)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of numbers as doubles; null is NaN."""
    return batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)


def _cells(batch: pa.RecordBatch, targets: Sequence[str], k: int, fold_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Grades by cell (0 where absent), and which rows a cell is fitted on."""
    y = np.tile(np.stack([_column(batch, t) for t in targets], 1), k)
    other = np.repeat(np.arange(k), len(targets))[None, :] != _column(batch, fold_col)[:, None]
    return np.nan_to_num(y), (other & ~np.isnan(y)).astype(np.float64)


@dataclass
class WideRidge:
    intercepts: np.ndarray          # cells; cell = fold * T + target
    weights: np.ndarray             # width x cells
    k: int
    targets: tuple
    passes: int
    residuals: np.ndarray           # relative, of the last pass
    stopped_by: list                # of each cell: tolerance or passes

    def table(self, spark) -> DataFrame:
        """``(fold, target, intercept, w, passes, stopped_by)``, a row for each cell."""
        rows = [(*divmod(c, len(self.targets)), float(self.intercepts[c]), self.weights[:, c].tolist(), self.passes,
                 self.stopped_by[c]) for c in range(len(self.intercepts))]
        rows = [(f, self.targets[t], *rest) for f, t, *rest in rows]
        return spark.createDataFrame(rows, "fold int, target string, intercept double, w array<double>, passes int, "
                                           "stopped_by string")


def ridge_cells(df: DataFrame, targets: Sequence[str], k: int, width: int, lam: float, tol: float = 1e-10,
                max_passes: int = 1000, fold_col: str = "fold") -> WideRidge:
    """Ridge with a free intercept for every (fold, target), on the rows outside the fold.

    ``df`` has ``indices``, ``values``, the fold and the targets, and is scanned once a
    pass, so the caller stores it. The first pass gives means and the diagonal, which
    scales the steps; each further one multiplies by the centred matrix. A cell ends
    when its residual is ``tol`` times the right-hand side; ``stopped_by`` says
    ``passes`` where the limit came first. Rows with a null target take no part in its
    cells; a cell without rows has zero weights.
    """
    targets = tuple(targets)
    cells = k * len(targets)
    rows = df.select(fold_col, "indices", "values", *targets)

    def summed(share) -> dict:
        def fn(batches):
            total: dict = {}
            for batch in batches:
                if batch.num_rows:
                    y, mask = _cells(batch, targets, k, fold_col)
                    for name, part in share(_Rows(batch, width), y, mask).items():
                        total[name] = total[name] + part if name in total else part
            if total:
                yield pa.RecordBatch.from_pylist(blocks(total), pa.schema(
                    [("_name", pa.string()), ("_blk", pa.int32()), ("_v", pa.list_(pa.float64())), ("_part", pa.int32())]))

        return collect_blocks(block_sum(rows.mapInArrow(fn, BLOCK_SCHEMA), []), []).get((), {})

    got = summed(lambda x, y, m: {"n": m.sum(0), "sy": (m * y).sum(0), "sx": x.transposed_times(m),
                                  "sxy": x.transposed_times(m * y), "sxx": x.transposed_times(m, 2)})
    matrix = lambda name: got[name].reshape(width, cells) if got else np.zeros((width, cells))
    n = np.maximum(got["n"] if got else np.zeros(cells), 1.0)
    mean_x, mean_y = matrix("sx") / n, (got["sy"] if got else np.zeros(cells)) / n
    right = matrix("sxy") - n * mean_x * mean_y
    diagonal = np.maximum(matrix("sxx") - n * mean_x ** 2, 0.0) + lam
    diagonal[diagonal == 0] = 1.0                 # a column of zeros, without a penalty

    norm = lambda a: np.sqrt((a * a).sum(0))
    w, rest = np.zeros((width, cells)), right.copy()
    scaled = rest / diagonal
    way, energy = scaled.copy(), (rest * scaled).sum(0)
    goal = tol * norm(right)
    live, passes = norm(rest) > goal, 1
    while live.any() and passes < max_passes:
        p = way * live
        moved = summed(lambda x, y, m: {"q": x.transposed_times(m * x.times(p))})["q"].reshape(width, cells)
        moved += lam * p - n * mean_x * (mean_x * p).sum(0)
        bend = (p * moved).sum(0)
        step = np.where(live & (bend > 0), energy / np.where(bend > 0, bend, 1.0), 0.0)
        w += step * p
        rest -= step * moved
        scaled = rest / diagonal
        new = (rest * scaled).sum(0)
        way = scaled + np.where(live, new / np.where(energy > 0, energy, 1.0), 0.0) * way
        energy = new
        live &= (norm(rest) > goal) & (bend > 0)
        passes += 1
    residual = norm(rest) / np.maximum(norm(right), 1e-300)
    return WideRidge(mean_y - (mean_x * w).sum(0), w, k, targets, passes, residual,
                     ["passes" if x else "tolerance" for x in live])


def predict_rows(df: DataFrame, model: WideRidge, fold_col: str | None = "fold",
                 keep: Sequence[str] | None = None) -> DataFrame:
    """Long predictions, ``target`` and ``pred`` beside the rows' columns (or those to
    ``keep``): by the model of the row's own fold (J7), or without ``fold_col`` by the mean
    of the k models (J8). A task holds the model's ``width x cells`` numbers."""
    t_n = len(model.targets)
    w, b = model.weights, model.intercepts
    if fold_col is None:
        w, b = (np.stack([x[..., j::t_n].mean(-1) for j in range(t_n)], axis=-1) for x in (w, b))
    kept = df.columns if keep is None else list(keep)

    def score(batches):
        for batch in batches:
            if batch.num_rows:
                z = _Rows(batch, len(w)).times(w) + b
                for j, t in enumerate(model.targets):
                    at = j if fold_col is None else _column(batch, fold_col).astype(int) * t_n + j
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c) for c in kept), pa.array([t] * batch.num_rows, pa.string()),
                         pa.array(z[np.arange(batch.num_rows), at])], [*kept, "target", "pred"])

    rows = df.where(F.col(fold_col).isNotNull()) if fold_col else df
    return rows.mapInArrow(score, T.StructType([*df.select(*kept).schema.fields, T.StructField("target", T.StringType()),
                                                T.StructField("pred", T.DoubleType())]))
