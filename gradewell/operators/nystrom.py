"""Nyström features for kernel regression.

The kernel matrix is approximated through ``m`` landmark rows:
``K ~ C W^-1 C'``, so ``z(x) = W^-1/2 k(x, landmarks)`` has the kernel's inner
products, and a linear fit on z is kernel regression in the landmarks' span. The
landmarks are drawn by ridge leverage: a row that the pilot landmarks explain badly
is likelier to become one. Pilot rows and landmarks are the rows of least hash, and
of least ``-log(hash) / leverage``, so retried tasks draw the same ones; only they
reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are worked on at a time: a task holds this many times the landmarks.
ROWS = 2048


def rbf(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    """``exp(-gamma |x - y|^2)`` of every pair of rows."""
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    return np.exp(-gamma * np.maximum(square, 0.0))


def inverse_root(w: np.ndarray, least: float = 1e-10) -> np.ndarray:
    """``W^-1/2`` on the span of the eigenvectors that matter; repeated landmarks add nothing."""
    values, vectors = np.linalg.eigh((w + w.T) / 2)
    keep = values > least * max(values.max(initial=0.0), 1.0)
    return vectors[:, keep] / np.sqrt(values[keep])


@dataclass
class NystromFeatures:
    """``z(x)``; a feature map for ``gradient.fit_cells``."""

    landmarks: np.ndarray          # m x d
    root: np.ndarray               # m x rank
    gamma: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        parts = [rbf(x[i:i + ROWS], self.landmarks, self.gamma) @ self.root for i in range(0, max(len(x), 1), ROWS)]
        return np.concatenate(parts)

    def out_dim(self, d: int) -> int:
        return self.root.shape[1]

    @classmethod
    def of(cls, landmarks: np.ndarray, gamma: float) -> NystromFeatures:
        return cls(landmarks, inverse_root(rbf(landmarks, landmarks, gamma)), gamma)


def _uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from a row's key."""
    h = F.xxhash64(F.lit(seed), key)
    return (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def _first(df: DataFrame, order: Column, feature_col: str, key_col: str, n: int) -> np.ndarray:
    rows = df.orderBy(order, key_col).limit(n).select(feature_col).collect()     # n rows, a parameter
    return np.array([r[0] for r in rows], np.float64)


def leverage(df: DataFrame, feature_col: str, key_col: str, pilot: np.ndarray, gamma: float, lam: float) -> DataFrame:
    """``(key, x, leverage)``: how badly the pilot rows explain each row, by
    ``(k(x, x) - k_x' (W + lam I)^-1 k_x) / lam``, at most 1."""
    inner = np.linalg.inv(rbf(pilot, pilot, gamma) + lam * np.eye(len(pilot)))

    def fn(batches):
        for pdf in batches:
            out = []
            for i in range(0, len(pdf), ROWS):
                k = rbf(np.stack(pdf["x"].iloc[i:i + ROWS].to_numpy()).astype(np.float64), pilot, gamma)
                out.append(np.clip((1.0 - ((k @ inner) * k).sum(1)) / lam, 1e-6, 1.0))
            yield pdf.assign(leverage=np.concatenate(out) if out else np.zeros(0))

    rows = df.select(F.col(key_col).alias("key"), F.col(feature_col).cast("array<double>").alias("x"))
    key_type = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(fn, f"key {key_type}, x array<double>, leverage double")


def draw(df: DataFrame, feature_col: str, key_col: str, m: int, gamma: float, seed: int, pilot: int | None = None,
         lam: float = 1e-2) -> NystromFeatures:
    """Features from at most ``m`` landmarks of ``df``'s rows, drawn without replacement by
    leverage against ``pilot`` (default m) uniformly drawn rows. Two passes; ``m`` and
    ``pilot`` rows reach the driver. Rows without a vector are left out."""
    rows = df.where(F.col(feature_col).isNotNull())
    first = _first(rows, _uniform(F.col(key_col), seed), feature_col, key_col, pilot or m)
    if not len(first):
        raise ValueError("no row to draw landmarks from")
    weighted = leverage(rows, feature_col, key_col, first, gamma, lam)
    order = -F.log(_uniform(F.col("key"), seed + 1)) / F.col("leverage")
    return NystromFeatures.of(_first(weighted, order, "x", "key", m), gamma)
