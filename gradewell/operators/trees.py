"""Boosted regression trees for every (fold, target) cell in the same passes.

Features are cut into bins at approximate quantiles once. A boosting round grows
one tree in every live cell, best leaf first: each task adds up residuals and rows
by (node, feature, bin), Spark sums these histograms, and the driver picks the
splits of all cells. A pass measures the smaller child of every leaf that may still
be split within the limit of leaves; the larger child's histogram is the parent's
less the smaller one's. So a pass counts at most half of the rows, and a tree takes
as many passes as it has levels, not leaves. Prediction starts from the training mean and every tree
is shrunk. The first pass of a round also returns the squared error on the cell's
held-out fold, so a cell ends during training, once ``patience`` rounds brought
no lower error. Rows stay in Spark; their running predictions are written to the
shared folder every ``FLUSH`` rounds and tasks add the trees since then.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.config import GBT_MAX_ROUNDS, GBT_PATIENCE
from gradewell.operators.treesum import BLOCK_SCHEMA, block_sum, blocks, collect_blocks
from gradewell.session import scratch_path

# FIXED VALUES (reference boosting settings): learning rate 0.01, feature and
# row sampling 0.8 (rows drawn anew every 10 rounds), L2 penalty 2, 50 leaves, 5 rows
# in a leaf at least, patience 500, at most 6000 rounds.
STEP_SIZE = 0.01
SAMPLE = 0.8
L2 = 2.0
SAMPLE_ROUNDS = 10
MAX_LEAVES = 50
MIN_ROWS = 5

FLUSH = 25


class Tree:
    """Nodes as lists; ``feature`` is -1 in a leaf, and rows whose bin is above
    ``cut`` go right."""

    def __init__(self):
        self.feature, self.cut, self.left, self.right, self.value = [-1], [0], [0], [0], [0.0]

    def split(self, node: int, feature: int, cut: int, values: tuple[float, float]) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, at, at + 1
        for column, new in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0)):
            column += [new, new]
        self.value += values
        return at, at + 1

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row: a mask of rows goes down each branch, so a node costs one
        comparison of a column. A node stands after its parent."""
        out = np.zeros(len(bins), np.int64)
        held = {0: np.ones(len(bins), bool)}
        for node, feature in enumerate(self.feature):
            here = held.pop(node)
            if feature < 0:
                out[here] = node
            else:
                above = bins[:, feature] > self.cut[node]
                held[self.right[node]], held[self.left[node]] = here & above, here & ~above
        return out

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


@dataclass
class BoostedCells:
    edges: np.ndarray              # features x (bins - 1) upper bounds
    base: np.ndarray               # training mean of each cell; cell = fold * T + target
    trees: list[list[Tree]]        # the best prefix of each cell
    k: int
    targets: tuple
    step_size: float
    summary: list[dict]
    counted: list[tuple[int, int]] = field(default_factory=list)    # of each later pass: rows counted, rows of the split leaves


def patience_step(best: tuple[float, int], i: int, value: float, patience: int) -> tuple[tuple[float, int], bool]:
    """Lowest value with its place after value ``i``, and whether to stop; ties keep the earliest."""
    if value < best[0]:
        return (value, i), False
    return best, i - best[1] >= patience


def best_prefix(curve: Sequence[float], patience: int) -> tuple[int, int]:
    """(best_iteration, stop_iteration) of a whole curve, 0-based."""
    best = (float("inf"), -1)
    for i, v in enumerate(curve):
        best, stop = patience_step(best, i, v, patience)
        if stop:
            return best[1], i
    return best[1], len(curve) - 1


def bin_edges(df: DataFrame, feature_col: str, bins: int) -> np.ndarray:
    """Approximate quantiles of every feature, from one aggregation."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    rows = (df.select(F.posexplode(feature_col)).groupBy("pos")
            .agg(F.percentile_approx("col", shares, 10_000).alias("q")).orderBy("pos").collect())
    return np.array([r["q"] for r in rows], np.float64)


def _binned(vectors, edges: np.ndarray) -> np.ndarray:
    x = np.stack(vectors).astype(np.float64)
    return np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(len(edges))], axis=1).astype(np.uint8)


def _state_rows(pdf: pd.DataFrame, n_features: int):
    bins = np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(len(pdf), n_features)
    return bins, np.frombuffer(b"".join(pdf["pred"]), np.float64).reshape(len(pdf), -1)


def _sampled(ids: np.ndarray, seed: int, share: float) -> np.ndarray:
    """Whether each row is in a round's sample: a hash of id and round, so a task
    that runs again draws the same rows."""
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(11)).astype(np.float64) < share * 2.0 ** 53


def _advance(pred: np.ndarray, bins: np.ndarray, pending: list[dict[int, Tree]], step: float) -> np.ndarray:
    pred = pred.copy()
    for made in pending:
        for cell, tree in made.items():
            pred[:, cell] += step * tree.predict(bins)
    return pred


def _histograms(pending, growing: dict[int, Tree], measured: dict[int, list[int]], targets, shape,
                step: float, seed: int, share: float, held_out: bool):
    n_features, n_bins = shape

    def fn(batches):
        sums = {c: np.zeros((2, len(measured[c]) * n_features * n_bins)) for c in growing}
        error = np.zeros((2, max(growing) + 1))
        offset = np.arange(n_features) * n_bins
        for pdf in batches:
            if pdf.empty:
                continue
            bins, pred = _state_rows(pdf, n_features)
            pred = _advance(pred, bins, pending, step)
            fold = pdf["fold"].to_numpy()
            inside = _sampled(pdf["id"].to_numpy(), seed, share)
            labels = pdf[list(targets)].to_numpy(np.float64)
            for c, tree in growing.items():
                f, t = divmod(c, len(targets))
                rest = labels[:, t] - pred[:, c]
                known = ~np.isnan(rest)
                if held_out:
                    judged = rest[known & (fold == f)]
                    error[0, c] += (judged * judged).sum()
                    error[1, c] += len(judged)
                place = np.full(len(tree.feature), -1)
                place[measured[c]] = np.arange(len(measured[c]))
                place = place[tree.leaves(bins)]
                rows = np.flatnonzero(known & inside & (fold != f) & (place >= 0))
                cell = (place[rows, None] * (n_features * n_bins) + offset + bins[rows]).ravel()
                size = sums[c].shape[1]
                sums[c][0] += np.bincount(cell, np.repeat(rest[rows], n_features), size)
                sums[c][1] += np.bincount(cell, minlength=size)
        yield pd.DataFrame(blocks({**{f"h{c}": h for c, h in sums.items()}, "error": error}),
                           columns=["_name", "_blk", "_v", "_part"])

    return fn


def best_split(sums: np.ndarray, features: np.ndarray, lam: float, min_rows: int) -> tuple | None:
    """``(gain, feature, cut, left value, right value, rows left, rows)`` of a leaf, or None;
    ``sums`` is (2, features, bins): residuals and rows. Of equal gains, to nine digits,
    the first counts, so that sums got by subtraction split as measured ones do."""
    left = sums.cumsum(axis=2)
    total = left[..., -1:]
    right = total - left
    allowed = (left[1] >= min_rows) & (right[1] >= min_rows)
    allowed[np.setdiff1d(np.arange(sums.shape[1]), features)] = False
    safe = lambda n: np.where(n + lam > 0, n + lam, 1.0)
    gain = left[0] ** 2 / safe(left[1]) + right[0] ** 2 / safe(right[1]) - total[0] ** 2 / safe(total[1])
    gain = np.where(allowed, gain, 0.0)
    best = gain.max(initial=0.0)
    if best <= 1e-12 * max(1.0, float((total[0] ** 2).max(initial=0.0))):
        return None
    feature, cut = np.unravel_index((gain >= best * (1 - 1e-9)).argmax(), gain.shape)
    at = (feature, cut)
    return (float(best), int(feature), int(cut), float(left[0][at] / safe(left[1][at])),
            float(right[0][at] / safe(right[1][at])), int(round(left[1][at])), int(round(total[1][at[0], 0])))


class Growth:
    """One cell's tree while it grows: ``tree`` has every node looked at so far, and
    ``asked`` are those whose histograms the next pass measures."""

    def __init__(self, features: np.ndarray, lam: float, min_rows: int, max_leaves: int, max_depth: int | None):
        self.features, self.lam, self.min_rows = features, lam, min_rows
        self.max_leaves, self.max_depth = max_leaves, max_depth or np.inf
        self.tree, self.asked = Tree(), [0]
        self.depth, self.parent = [0], [-1]
        self.sums: dict[int, np.ndarray] = {}                # of the leaves that are known
        self.found: dict[int, tuple] = {}                    # best split of a node that has one
        self.rows = self.parent_rows = 0                     # counted by the last pass; of the leaves split

    def learn(self, measured: np.ndarray) -> None:
        """Take in the histograms of the nodes asked for, (2, nodes, features, bins)."""
        self.rows = self.parent_rows = 0
        for i, node in enumerate(self.asked):
            self.sums[node] = measured[:, i]
            self.rows += int(measured[1, i, 0].sum()) if measured.shape[2] else 0
            made = [node]
            if node:
                above = self.parent[node]
                other = self.tree.left[above] + self.tree.right[above] - node
                whole = self.sums.pop(above)
                self.parent_rows += int(whole[1, 0].sum())
                self.sums[other] = whole - self.sums[node]
                made.append(other)
            for n in made:
                split = best_split(self.sums[n], self.features, self.lam, self.min_rows)
                if split:
                    self.found[n] = split
        self.asked = []

    def grown(self) -> Tree | None:
        """The tree of the best splits in order, or None if nodes must be measured first."""
        heap = [(-self.found[0][0], 0)] if 0 in self.found else []
        out, places = Tree(), {0: 0}
        leaves = 1
        while heap and leaves < self.max_leaves:
            _, node = heapq.heappop(heap)
            gain, feature, cut, *values = self.found[node][:5]
            left, right = out.split(places[node], feature, cut, tuple(values))
            leaves += 1
            if leaves == self.max_leaves or self.depth[node] + 1 >= self.max_depth:
                continue
            if self.tree.feature[node] < 0:
                # as many more leaves can be split, so the others that are known need no look
                rest = [n for _, n in heapq.nsmallest(self.max_leaves - leaves, heap)]
                for n in [node, *rest]:
                    if self.tree.feature[n] < 0 and self.depth[n] + 1 < self.max_depth:
                        self._open(n)
                return None
            for child, place in ((self.tree.left[node], left), (self.tree.right[node], right)):
                places[child] = place
                if child in self.found:
                    heapq.heappush(heap, (-self.found[child][0], child))
        return out

    def _open(self, node: int) -> None:
        _, feature, cut, *values, n_left, n = self.found[node]
        children = self.tree.split(node, feature, cut, tuple(values))
        self.depth += [self.depth[node] + 1] * 2
        self.parent += [node] * 2
        self.asked.append(children[0] if 2 * n_left <= n else children[1])


def boost_cells(df: DataFrame, feature_col: str, targets: Sequence[str], k: int, id_col: str,
                step_size: float = STEP_SIZE, max_rounds: int = GBT_MAX_ROUNDS, patience: int = GBT_PATIENCE,
                lam: float = L2, max_leaves: int = MAX_LEAVES, max_depth: int | None = None, min_rows: int = MIN_ROWS,
                row_share: float = SAMPLE, feature_share: float = SAMPLE, bins: int = 32, seed: int = 42,
                fold_col: str = "fold") -> BoostedCells:
    """Boost every (fold, target) cell on the rows outside its fold.

    ``summary`` has for each cell the trees kept, the rounds tried, the held-out
    RMSE and ``stopped_by``: ``patience``, ``no_split`` (no leaf can be split any
    more) or ``rounds`` (the limit). Rows with a null label take no part in that
    label's cells. Leaves are split best first, up to ``max_leaves`` and, if given,
    ``max_depth`` levels. The driver holds histograms of cells x leaves x features x
    bins, and the trees.
    """
    spark, targets = df.sparkSession, tuple(targets)
    edges = bin_edges(df, feature_col, bins)
    n_features, cells = len(edges), k * len(targets)
    base = np.zeros(cells)
    parts = df.groupBy(fold_col).agg(*[F.sum(t).alias(f"s_{t}") for t in targets],
                                     *[F.count(t).alias(f"n_{t}") for t in targets]).collect()
    for c in range(cells):
        f, t = divmod(c, len(targets))
        train = [r for r in parts if r[fold_col] != f]
        base[c] = sum(r[f"s_{targets[t]}"] or 0.0 for r in train) / max(sum(r[f"n_{targets[t]}"] for r in train), 1)
    schema = (f"id long, fold int, {', '.join(f'{t} double' for t in targets)}, bins binary, pred binary")

    def start(batches):
        for pdf in batches:
            if not pdf.empty:
                packed = [row.tobytes() for row in _binned(pdf.pop("x").to_numpy(), edges)]
                yield pdf.assign(bins=packed, pred=[base.tobytes()] * len(pdf))

    def stored(state):
        path = scratch_path(spark, "boosting")
        state.write.parquet(path)
        return spark.read.schema(schema).parquet(path)

    def flush(made):
        def fn(batches):
            for pdf in batches:
                if not pdf.empty:
                    bins_, pred = _state_rows(pdf, n_features)
                    yield pdf.assign(pred=[row.tobytes() for row in _advance(pred, bins_, made, step_size)])

        return fn

    state = stored(df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("id"),
                             F.col(fold_col).cast("int").alias("fold"),
                             *[F.col(t).cast("double").alias(t) for t in targets], F.col(feature_col).alias("x"))
                   .mapInPandas(start, schema))
    rng = np.random.default_rng(seed)
    made: list[list[Tree]] = [[] for _ in range(cells)]
    best = [(float("inf"), -1)] * cells          # lowest squared error and its number of trees
    ended = [""] * cells
    tried = [0] * cells
    counted: list[tuple[int, int]] = []
    taken: list[Growth] = []                     # what the next pass measures for
    pending: list[dict[int, Tree]] = []
    round_ = 0
    if not n_features:                           # an empty table
        ended = ["no_split"] * cells
    while not all(ended):
        live = [c for c in range(cells) if not ended[c]]
        growing = {}
        for c in live:
            drawn = np.sort(rng.permutation(n_features)[:max(1, round(feature_share * n_features))])
            growing[c] = Growth(drawn, lam, min_rows, max_leaves, max_depth)
        grown: dict[int, Tree] = {}
        first = True
        while growing:
            asked = {c: g.asked for c, g in growing.items()}
            fn = _histograms(pending, {c: g.tree for c, g in growing.items()}, asked, targets, (n_features, bins),
                             step_size, seed + round_ // SAMPLE_ROUNDS, row_share, held_out=first)
            got = collect_blocks(block_sum(state.mapInPandas(fn, BLOCK_SCHEMA), []), []).get((), {})
            for c in live if first else ():
                error, n = got["error"].reshape(2, -1)[:, c] if got else (0.0, 0)
                best[c], stop = patience_step(best[c], round_, error / n if n else float("inf"), patience)
                tried[c] = round_
                ended[c] = "patience" if stop else "rounds" if round_ >= max_rounds else ""
                if ended[c]:
                    del growing[c]
            for c, growth in list(growing.items()):
                shape = (2, len(growth.asked), n_features, bins)
                growth.learn(got[f"h{c}"].reshape(shape) if got else np.zeros(shape))
                tree = growth.grown()
                if tree is not None:
                    del growing[c]
                    if len(tree.feature) == 1:
                        ended[c] = "no_split"
                    else:
                        grown[c] = tree
            if not first:
                counted.append((sum(g.rows for g in taken), sum(g.parent_rows for g in taken)))
            first, taken = False, list(growing.values())
        for c, tree in grown.items():
            made[c].append(tree)
        pending.append(grown)
        round_ += 1
        if len(pending) == FLUSH:
            state, pending = stored(state.mapInPandas(flush(pending), schema)), []
    summary = [{"fold": c // len(targets), "target": targets[c % len(targets)], "n_trees": max(best[c][1], 0),
                "rounds": tried[c], "stopped_by": ended[c],
                "valid_rmse": float(best[c][0]) ** 0.5 if np.isfinite(best[c][0]) else None} for c in range(cells)]
    return BoostedCells(edges, base, [made[c][:max(best[c][1], 0)] for c in range(cells)], k, targets, step_size, summary,
                        counted)


def predict_boosted(df: DataFrame, model: BoostedCells, feature_col: str, keep: Sequence[str], keep_schema: str,
                    fold_col: str | None = "fold") -> DataFrame:
    """Long predictions ``(keep…, target, pred)``: out-of-fold when ``fold_col`` is
    given, else averaged over the k fold models (J7 / J8)."""
    t_n = len(model.targets)

    def fn(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            bins = _binned(pdf[feature_col].to_numpy(), model.edges)
            pred = _advance(np.tile(model.base, (len(pdf), 1)), bins,
                            [{c: t} for c, trees in enumerate(model.trees) for t in trees], model.step_size)
            for j, t in enumerate(model.targets):
                own = pred[:, j::t_n]
                got = own[np.arange(len(pdf)), pdf[fold_col].to_numpy().astype(int)] if fold_col else own.mean(axis=1)
                yield pdf[list(keep)].assign(target=t, pred=got)

    columns = list(dict.fromkeys([*keep, feature_col, *([fold_col] if fold_col else [])]))
    return df.select(*columns).mapInPandas(fn, f"{keep_schema}, target string, pred double")
