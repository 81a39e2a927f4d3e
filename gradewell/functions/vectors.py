"""Array-column vector expressions (JVM higher-order functions, codegen-friendly)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from gradewell.config import GRADE_SCALE, GRADE_SHIFT, NORMALISE_CLAMP


def sq_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)


def l2_normalise(v: Column, clamp: float = NORMALISE_CLAMP) -> Column:
    """v / max(||v||, clamp): a zero vector stays zero."""
    norm = F.greatest(F.sqrt(sq_norm(v)), F.lit(clamp))
    return F.transform(v, lambda x: x / norm)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def lit_array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def affine(v: Column, weights: np.ndarray, bias: Sequence[float]) -> list[Column]:
    """v @ W + b for a literal d x k matrix: k output columns."""
    return [dot(v, lit_array(weights[:, j])) + F.lit(float(bias[j])) for j in range(weights.shape[1])]


def scaled_sigmoid(x: Column, scale: float = GRADE_SCALE, shift: float = GRADE_SHIFT) -> Column:
    """scale * sigmoid(x) + shift: bounds grades to [shift, shift+scale]."""
    return F.lit(scale) / (F.lit(1.0) + F.exp(-x)) + F.lit(shift)


def halving_weights(n_layers: int, layer_start: int) -> dict[int, float]:
    """Layer weights 2^-i for i = 0.., reversed so the last layer weighs 1."""
    count = n_layers - layer_start + 1
    w = [2.0 ** -i for i in range(count)][::-1]
    return {layer_start + i: w[i] for i in range(count)}


def seeded_normal(seed: int, shape: tuple[int, ...], scale: float = 0.1) -> np.ndarray:
    """Fixed parameters for pooling heads: N(0, scale) from a seeded generator."""
    return np.random.default_rng(seed).normal(0.0, scale, size=shape)
