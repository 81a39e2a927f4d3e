"""Per-row loss expressions (reductions are ordinary aggregates)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradewell.config import ROOT_SE_EPS, SMOOTH_L1_BETA


def smooth_l1(d: Column, beta: float = SMOOTH_L1_BETA) -> Column:
    """0.5*d^2/beta when |d| < beta, else |d| - 0.5*beta."""
    a = F.abs(d)
    return F.when(a < F.lit(beta), F.lit(0.5) * d * d / F.lit(beta)).otherwise(a - F.lit(0.5 * beta))


def root_se(d: Column, eps: float = ROOT_SE_EPS) -> Column:
    """sqrt(d^2 + eps): the per-element 'RMSE' loss, which averages like MAE."""
    return F.sqrt(d * d + F.lit(eps))


def weighted_mean(val: Column, n: Column) -> Column:
    """n-weighted mean aggregate: sum(val*n) / sum(n)."""
    return F.sum(val * n) / F.sum(n)
