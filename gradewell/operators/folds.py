"""Deterministic k-fold assignment (balanced, stratified, repeated, iterative).

Every random choice is a hash of (seed, id): the order key is
``md5('<seed>:' || id)``, rows are numbered in that order inside their stratum
and ``fold = (rank - 1) mod k``. Folds are therefore a partition of the rows,
stratum sizes per fold differ by at most one, and the result does not depend
on input order or partitioning.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.operators.rowindex import global_row_index, hex_bucket


def hash_key(id_col: str, seed: int, salt: str = ""):
    prefix = f"{seed}:" + (f"{salt}:" if salt else "")
    return F.md5(F.concat(F.lit(prefix), F.col(id_col).cast("string")))


def assign_folds(df: DataFrame, id_col: str, k: int, seed: int,
                 strata: Sequence[str] = (), fold_col: str = "fold") -> DataFrame:
    """Add ``fold_col`` (INT). With no strata this is a balanced random k-fold."""
    keyed = df.withColumn("_fold_h", hash_key(id_col, seed))
    ranked = global_row_index(keyed, ["_fold_h", id_col], strata=strata,
                              bucket=hex_bucket("_fold_h"), name="_fold_rn")
    return ranked.withColumn(fold_col, F.pmod(F.col("_fold_rn") - 1, F.lit(k)).cast("int")) \
        .drop("_fold_h", "_fold_rn")


def repeated_folds(df: DataFrame, id_col: str, k: int, seeds: Sequence[int],
                   strata: Sequence[str] = ()) -> DataFrame:
    """Long fold table ``(cv_id, id, fold)``: one k-fold per seed.

    All seeds are numbered in one pass: the cv id joins the strata, so a
    single range-partitioned sort handles every repetition.
    """
    seed_arr = F.array(*[F.struct(F.lit(i).alias("cv_id"), F.lit(s).alias("_seed"))
                         for i, s in enumerate(seeds)])
    rep = df.select(id_col, *strata, F.inline(seed_arr))
    keyed = rep.withColumn("_fold_h", F.md5(F.concat(
        F.col("_seed").cast("string"), F.lit(":"), F.col(id_col).cast("string"))))
    ranked = global_row_index(keyed, ["_fold_h", id_col], strata=["cv_id", *strata],
                              bucket=hex_bucket("_fold_h"), name="_rn")
    return ranked.select(F.col("cv_id").cast("int"), id_col,
                         F.pmod(F.col("_rn") - 1, F.lit(k)).cast("int").alias("fold"))


def cv_roles(folds: DataFrame, k: int, fold_col: str = "fold") -> DataFrame:
    """Every (split, row) training cell: role = valid when the row's fold is the split.

    A generator (``explode(sequence)``) replaces the fold loop; no join.
    """
    return folds.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))) \
        .withColumn("role", F.when(F.col(fold_col) == F.col("split"), F.lit("valid"))
                    .otherwise(F.lit("train")))


def fold_sizes(folds: DataFrame, fold_col: str = "fold") -> DataFrame:
    return folds.groupBy(fold_col).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.col("n").desc(), F.col(fold_col))


# --------------------------------------------------------------------------
# Iterative stratification (Sechidis, Tsoumakas & Vlahavas, 2011) on the
# aggregated table of label tuples, for labels of any number of grades. The
# greedy runs on the driver over (#distinct tuples x k) numbers; rows are then
# assigned by rank ranges.
# --------------------------------------------------------------------------

#: Tuples that the driver shares out; more distinct ones are an error, not a sample.
MOST_TUPLES = 1_000_000


def _iterative_quotas(codes: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Quota[t, f] = rows of tuple t that go to fold f.

    ``codes[t]`` are the (label, value) pairs of tuple t, as numbers. Every fold gets a
    k-th of a tuple's rows; what remains of each, fewer than k rows, goes to the folds
    that are shortest of the tuple's pairs, the rarest pair's tuples first. Rows are then
    exchanged between two folds as long as that brings the pairs' counts nearer to a k-th
    each, and then at random with falling heat until every grade is within one of its
    share, or the steps are over (such a table may have no such folds).
    """
    n_tup, n_lab = codes.shape
    quotas = np.repeat((counts // k)[:, None], k, axis=1)
    rest = counts % k
    codes = np.hstack([codes, np.full((n_tup, 1), codes.max(initial=-1) + 1)])     # and the fold's size as a pair of all
    pair_total = np.bincount(codes.ravel(), np.repeat(counts, n_lab + 1))
    over = np.zeros((len(pair_total), k))                 # a pair's remainder rows in a fold, less their share
    np.subtract.at(over, codes.ravel(), np.repeat(rest / k, n_lab + 1)[:, None])
    extra = np.zeros((n_tup, k), dtype=bool)
    rarest = pair_total[codes[:, :-1]].min(axis=1) if n_lab else counts
    for t in np.lexsort((np.arange(n_tup), rarest)):
        if rest[t]:
            short = over[codes[t]]
            # the rarest pair decides, then all pairs together
            rare = over[codes[t, np.argmin(pair_total[codes[t]])]]
            to = np.lexsort((np.arange(k), short.sum(axis=0), rare))[:rest[t]]
            extra[t, to] = True
            over[np.ix_(codes[t], to)] += 1
    # each exchange lowers the sum of squares, so this ends
    while True:
        lean = over[codes].sum(axis=1)
        give, take = np.where(extra, lean, -np.inf), np.where(extra, np.inf, lean)
        gain = give.max(axis=1) - take.min(axis=1) - (n_lab + 1)
        t = int(np.argmax(gain)) if n_tup else 0
        if not n_tup or not gain[t] > 1e-9:
            _anneal(codes, extra, over)
            return quotas + extra
        a, b = int(give[t].argmax()), int(take[t].argmin())
        extra[t, a], extra[t, b] = False, True
        over[codes[t], a] -= 1
        over[codes[t], b] += 1


#: Exchanges that are tried, at most, where descent leaves a grade beyond one of its share.
MOST_EXCHANGES = 400_000


def _anneal(codes: np.ndarray, extra: np.ndarray, over: np.ndarray) -> None:
    """Exchange remainder rows of tuples between folds, in place, by simulated annealing on
    the sum of fourth powers, until no pair is more than one from its share."""
    movable = np.flatnonzero(extra.any(axis=1) & ~extra.all(axis=1))
    rng, heat = np.random.default_rng(0), 1.0
    for _ in range(min(200 * len(movable) * extra.shape[1] + 20_000, MOST_EXCHANGES) if len(movable) else 0):
        if np.abs(over).max() <= 1 + 1e-9:
            return
        t = movable[rng.integers(len(movable))]
        a, b = rng.choice(np.flatnonzero(extra[t])), rng.choice(np.flatnonzero(~extra[t]))
        x, y = over[codes[t], a], over[codes[t], b]
        worse = ((x - 1) ** 4 - x ** 4 + (y + 1) ** 4 - y ** 4).sum()
        if worse <= 0 or rng.random() < np.exp(-worse / (4 * heat)):
            extra[t, a], extra[t, b] = False, True
            over[codes[t], a] -= 1
            over[codes[t], b] += 1
        heat = max(0.02, heat * 0.9999)


def iterative_folds(df: DataFrame, id_col: str, label_cols: Sequence[str], k: int,
                    seed: int) -> DataFrame:
    """Multilabel iterative stratification over (label, value) pairs: every value of every
    label is a grade of its own, a NULL too."""
    labels = list(label_cols)
    lab = df.select(id_col, *[F.col(c).alias(f"_lab{i}") for i, c in enumerate(labels)])
    values = [F.coalesce(F.col(f"_lab{i}").cast("string"), F.lit("null")) for i in range(len(labels))]
    lab = lab.select(id_col, F.to_json(F.array(*values)).alias("_tuple"))
    rows = (lab.groupBy("_tuple").agg(F.count(F.lit(1)).alias("n")).orderBy("_tuple")
            .limit(MOST_TUPLES + 1).collect())          # one row per distinct label tuple
    if len(rows) > MOST_TUPLES:
        raise ValueError(f"more than {MOST_TUPLES} distinct label tuples: stratify on coarser grades")
    pairs: dict[tuple[int, str], int] = {}
    codes = np.array([[pairs.setdefault((i, v), len(pairs)) for i, v in enumerate(json.loads(r["_tuple"]))] for r in rows],
                     dtype=np.int64).reshape(-1, len(labels))
    counts = np.array([r["n"] for r in rows], dtype=np.int64)
    quotas = _iterative_quotas(codes, counts, k)
    ends = np.cumsum(quotas, axis=1)
    bounds = [(rows[t]["_tuple"], f, int(ends[t, f] - quotas[t, f]) + 1, int(ends[t, f]))
              for t in range(len(rows)) for f in range(k) if quotas[t, f]]
    bounds_df = df.sparkSession.createDataFrame(bounds, "_tuple string, fold int, _lo long, _hi long")
    ranked = global_row_index(lab.withColumn("_h", hash_key(id_col, seed)), ["_h", id_col],
                              strata=["_tuple"], bucket=hex_bucket("_h"), name="_rn")
    # at most tuples x k rows, and MOST_TUPLES bounds these
    joined = ranked.join(F.broadcast(bounds_df), "_tuple", "inner").where(
        (F.col("_rn") >= F.col("_lo")) & (F.col("_rn") <= F.col("_hi")))
    return joined.select(id_col, F.col("fold").cast("int"))
