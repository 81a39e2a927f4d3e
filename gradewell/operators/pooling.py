"""Vector pooling over token states ``(doc_id, layer, pos, mask, vec)``.

Sums of vectors run through ``pyspark.ml.stat.Summarizer`` on ML vectors: a
JVM aggregate with map-side partial aggregation, so a document's positions
are combined where they are read and the shuffle carries one partial vector
per (partition, document) instead of one row per (position, dimension).
Masks and layer weights enter as row weights: the weighted mean
sum(w*m*h)/sum(w*m) is exactly the masked, layer-weighted mean.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradewell.config import MAX_POOL_FILL, MEAN_POOL_CLAMP
from gradewell.functions import vectors as vf
from gradewell.operators.treesum import SINGLE_LEVEL_MAX, partition_id


def _weighted_mean(df: DataFrame, keys: list[str], weight: F.Column | None,
                   out: str = "vec") -> DataFrame:
    """sum(w*vec) / max(sum(w), 1e-9) per key group (weights >= 0).

    Zero-weight rows contribute a zero vector with unit weight to the vector
    sum (so every group is non-empty for the summarizer) and nothing to the
    weight total; a group whose weights sum to zero yields the zero vector,
    as with the reference's clamped denominator.
    """
    w = (weight if weight is not None else F.lit(1.0)).cast("double")
    prepared = df.withColumn("_w", w)
    pos = F.col("_w") > F.lit(0.0)
    vec = F.when(pos, F.col("vec")).otherwise(F.transform("vec", lambda x: F.lit(0.0)))
    prepared = prepared.withColumn("_v", array_to_vector(vec)) \
        .withColumn("_w1", F.when(pos, F.col("_w")).otherwise(F.lit(1.0)))
    agg = prepared.groupBy(*keys).agg(Summarizer.sum(F.col("_v"), F.col("_w1")).alias("_s"),
                                      F.sum("_w").alias("_ws"))
    denom = F.greatest(F.col("_ws"), F.lit(MEAN_POOL_CLAMP))
    return agg.select(*keys, F.transform(vector_to_array(F.col("_s")), lambda x: x / denom).alias(out))


def mean_pool(states: DataFrame, layer: int | None = None) -> DataFrame:
    """Masked mean over positions (I1): sum(mask*h) / max(sum(mask), 1e-9)."""
    s = states if layer is None else states.where(F.col("layer") == layer)
    return _weighted_mean(s, ["doc_id"], F.col("mask"))


def max_pool(states: DataFrame, layer: int, fill: float = MAX_POOL_FILL) -> DataFrame:
    """Masked max (I2): padded positions take the value ``fill``."""
    s = states.where(F.col("layer") == layer).withColumn(
        "vec", F.when(F.col("mask") == 1, F.col("vec"))
        .otherwise(F.transform("vec", lambda x: F.lit(fill))))
    agg = s.groupBy("doc_id").agg(Summarizer.max(array_to_vector("vec")).alias("_m"))
    return agg.select("doc_id", vector_to_array("_m").alias("vec"))


def min_pool(states: DataFrame, layer: int, fill: float | None = None) -> DataFrame:
    """Masked min (I3). Default ignores padded positions; ``fill`` reproduces
    the reference's constant fill (1e-4), with which padding can win."""
    s = states.where(F.col("layer") == layer)
    if fill is None:
        s = s.where(F.col("mask") == 1)
    else:
        s = s.withColumn("vec", F.when(F.col("mask") == 1, F.col("vec"))
                         .otherwise(F.transform("vec", lambda x: F.lit(fill))))
    agg = s.groupBy("doc_id").agg(Summarizer.min(array_to_vector("vec")).alias("_m"))
    return agg.select("doc_id", vector_to_array("_m").alias("vec"))


def first_token(states: DataFrame, layer: int) -> DataFrame:
    """First-position vector of one layer."""
    return states.where((F.col("layer") == layer) & (F.col("pos") == 0)).select("doc_id", "vec")


def _layer_weight(weights: dict[int, float]) -> F.Column:
    expr = None
    for layer, w in weights.items():
        expr = (F.when(F.col("layer") == layer, F.lit(w)) if expr is None
                else expr.when(F.col("layer") == layer, F.lit(w)))
    return expr.otherwise(F.lit(0.0))


def weighted_layer_pool(states: DataFrame, weights: dict[int, float]) -> DataFrame:
    """Layer-weighted average per position, then masked mean over positions.

    One aggregation: row weight = layer weight x mask.
    """
    s = states.where(F.col("layer").isin(list(weights)))
    return _weighted_mean(s, ["doc_id"], _layer_weight(weights) * F.col("mask"))


def mixed_pool(states: DataFrame, weights: dict[int, float]) -> DataFrame:
    """Masked mean per layer, then the layer-weighted average."""
    s = states.where(F.col("layer").isin(list(weights)))
    per_layer = _weighted_mean(s, ["doc_id", "layer"], F.col("mask"))
    return _weighted_mean(per_layer, ["doc_id"], _layer_weight(weights))


def softmax(score: F.Column, partition: list[str]) -> F.Column:
    """Max-shifted softmax of ``score`` over a window partition."""
    w = Window.partitionBy(*partition)
    e = F.exp(score - F.max(score).over(w))
    return e / F.sum(e).over(w)


def _merged(states: DataFrame, keys: list) -> DataFrame:
    """Softmax states of each key put together: ``most`` (the largest score), ``total`` (the
    sum of exp(score - most)) and ``vec`` (the sum of the vectors so weighted)."""
    held = states.groupBy(*keys).agg(F.max("most").alias("_top"), F.collect_list(F.struct("most", "total", "vec")).alias("_s"))
    scaled = F.transform("_s", lambda s: F.struct(
        (s["total"] * F.exp(s["most"] - F.col("_top"))).alias("total"),
        F.transform(s["vec"], lambda x: x * F.exp(s["most"] - F.col("_top"))).alias("vec")))
    names = [c for c in held.columns if not c.startswith("_")]
    held = held.select(*names, "_top", scaled.alias("_s"))
    both = F.aggregate(F.slice("_s", F.lit(2), F.size("_s")), F.element_at("_s", 1), lambda acc, s: F.struct(
        (acc["total"] + s["total"]).alias("total"),
        F.zip_with(acc["vec"], s["vec"], lambda x, y: x + y).alias("vec")))
    return held.select(*names, F.col("_top").alias("most"), both.alias("_m")).select(*names, "most", "_m.total", "_m.vec")


def _attended(states: DataFrame, key: str) -> DataFrame:
    """``(key, vec)``: softmax states of each key merged, weighted sum over total."""
    return _merged(states, [key]).select(key, F.transform("vec", lambda x: x / F.col("total")).alias("vec"))


def layer_attention(states: DataFrame, q: np.ndarray, w_h: np.ndarray,
                    layers: list[int]) -> DataFrame:
    """First-token layer attention (I5): softmax over layers of q.h_l, the
    attention-weighted sum of h_l, then a linear map to ``w_h.shape[1]`` outputs.

    One exchange; a document has one state for each of its few layers.
    """
    s = first_token_layers(states, layers)
    scored = s.select("doc_id", vf.dot(F.col("vec"), vf.lit_array(q)).alias("most"), F.lit(1.0).alias("total"), "vec")
    ctx = _attended(scored, "doc_id")
    outs = vf.affine(F.col("vec"), w_h, [0.0] * w_h.shape[1])
    return ctx.select("doc_id", F.array(*outs).alias("vec"))


def first_token_layers(states: DataFrame, layers: list[int]) -> DataFrame:
    return states.where((F.col("pos") == 0) & F.col("layer").isin(layers))


def batch_softmax_head(states: DataFrame, layers: list[int], batch_size: int,
                       a: np.ndarray, a0: float, b: np.ndarray, b0: np.ndarray) -> DataFrame:
    """Per-layer mean pool, softmax across the documents of a batch (the
    reference's batch-axis softmax; the batch id is explicit), a layer-linear
    map, a linear map to outputs, then 4*sigmoid+1 (I8)."""
    s = states.where(F.col("layer").isin(layers))
    per_layer = _weighted_mean(s, ["doc_id", "layer"], F.col("mask"))
    long = per_layer.select("doc_id", "layer", F.posexplode("vec").alias("dim", "x")) \
        .withColumn("batch", F.expr(f"doc_id div {batch_size}"))
    long = long.withColumn("_sm", softmax(F.col("x"), ["batch", "layer", "dim"]))
    lw = None
    for i, layer in enumerate(layers):
        lw = (F.when(F.col("layer") == layer, F.lit(float(a[i]))) if lw is None
              else lw.when(F.col("layer") == layer, F.lit(float(a[i]))))
    z = long.groupBy("doc_id", "dim").agg((F.sum(lw * F.col("_sm")) + F.lit(a0)).alias("z"))
    vecs = z.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("dim", "z"))).alias("_zs"))
    zvec = F.transform("_zs", lambda e: e["z"])
    outs = [vf.scaled_sigmoid(o) for o in vf.affine(zvec, b, b0)]
    return vecs.select("doc_id", F.array(*outs).alias("vec"))


# ---------------------------------------------------------------- attention pool

def _erf(x: np.ndarray) -> np.ndarray:
    """erf by its series of positive terms, over whole arrays; 1 past |x| = 6."""
    x = np.clip(x, -6.0, 6.0)
    square = 2.0 * x * x
    term = x.copy()
    total = x.copy()
    for n in range(1, 160):
        term = term * (square / (2 * n + 1))
        total += term
    return 2.0 / np.sqrt(np.pi) * np.exp(-x * x) * total


def _attention_scores(w1: np.ndarray, b1: np.ndarray, gamma: np.ndarray, beta: np.ndarray,
                      w2: np.ndarray, b2: float) -> Callable:
    """Score MLP per position: Linear -> LayerNorm -> GELU (exact, erf) -> Linear."""
    def fn(vecs: pd.Series) -> pd.Series:
        if len(vecs) == 0:
            return pd.Series([], dtype="float64")
        x = np.stack(vecs.to_numpy()).astype(np.float64)
        h = x @ w1 + b1
        mu = h.mean(axis=1, keepdims=True)
        var = h.var(axis=1, keepdims=True)
        h = (h - mu) / np.sqrt(var + 1e-5) * gamma + beta
        h = 0.5 * h * (1.0 + _erf(h / np.sqrt(2.0)))
        return pd.Series(h @ w2 + b2)

    return fn


#: Softmax states that a task holds before it passes them on.
HELD_STATES = 4096


def _attention_states(score: Callable):
    """Softmax states ``(doc_id, most, total, vec, part)`` of a task's rows: one for each
    document, or a few where the task has more documents than it holds."""
    def fn(batches):
        part, held = partition_id(), {}

        def rows():
            out = pd.DataFrame([(d, m, t, v, part) for d, (m, t, v) in held.items()],
                               columns=["doc_id", "most", "total", "vec", "part"])
            held.clear()
            return out

        for pdf in batches:
            if pdf.empty:
                continue
            x, scores = np.stack(pdf["vec"].to_numpy()).astype(np.float64), score(pdf["vec"]).to_numpy()
            docs, which = np.unique(pdf["doc_id"].to_numpy(), return_inverse=True)
            most = np.full(len(docs), -np.inf)
            np.maximum.at(most, which, scores)
            e = np.exp(scores - most[which])
            total = np.bincount(which, e, len(docs))
            vec = np.zeros((len(docs), x.shape[1]))
            np.add.at(vec, which, e[:, None] * x)
            for d, m, t, v in zip(docs.tolist(), most, total, vec):
                if d in held:
                    m0, t0, v0 = held[d]
                    top = max(m, m0)
                    held[d] = (top, t * np.exp(m - top) + t0 * np.exp(m0 - top),
                               v * np.exp(m - top) + v0 * np.exp(m0 - top))
                else:
                    held[d] = (m, t, v)
            if len(held) >= HELD_STATES:
                yield rows()
        if held:
            yield rows()

    return fn


def attention_pool(states: DataFrame, layer: int, params: dict) -> DataFrame:
    """Attention pooling (I4): MLP score per position, masked softmax over positions,
    weighted sum, in one pass and one exchange.

    A task turns its positions into softmax states, which can be merged: a long document
    is a state of each task that has a part of it, not rows of one window. Where there
    are many tasks, states are merged in groups of tasks first. A document without an
    unmasked position has no row.
    """
    rows = states.where((F.col("layer") == layer) & (F.col("mask") == 1)).select("doc_id", "vec")
    found = rows.mapInPandas(_attention_states(_attention_scores(**params)),
                             "doc_id long, most double, total double, vec array<double>, part int")
    tasks = max(states.sparkSession.sparkContext.defaultParallelism,
                int(states.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if tasks > SINGLE_LEVEL_MAX:
        found = _merged(found, ["doc_id", F.pmod(F.col("part"), F.lit(int(tasks ** 0.5))).alias("part")])
    return _attended(found, "doc_id")


def attention_params(seed: int, d: int) -> dict:
    rng = np.random.default_rng(seed)
    return {"w1": rng.normal(0, 0.1, (d, d)), "b1": rng.normal(0, 0.1, d),
            "gamma": np.ones(d), "beta": np.zeros(d),
            "w2": rng.normal(0, 0.1, d), "b2": float(rng.normal(0, 0.1))}


def to_long(vecs: DataFrame, key: str = "doc_id", vec: str = "vec") -> DataFrame:
    """``(key, dim, value)`` rows for comparison and reporting."""
    return vecs.select(key, F.posexplode(vec).alias("dim", "value"))


# ---------------------------------------------------------------- selector

POOLERS = {
    "mean": lambda st, layer, **kw: mean_pool(st, layer),
    "max": lambda st, layer, **kw: max_pool(st, layer, **kw),
    "min": lambda st, layer, **kw: min_pool(st, layer, **kw),
    "first": lambda st, layer, **kw: first_token(st, layer),
    "weightedlayer": lambda st, layer, weights, **kw: weighted_layer_pool(st, weights),
    "mixed": lambda st, layer, weights, **kw: mixed_pool(st, weights),
    "attention": lambda st, layer, params, **kw: attention_pool(st, layer, params),
    "attention_sup": lambda st, layer, q, w_h, layers, **kw: layer_attention(st, q, w_h, layers),
    "absurd": lambda st, layer, head, **kw: batch_softmax_head(st, **head),
}


def pool(states: DataFrame, name: str, layer: int, **kw) -> DataFrame:
    """Pooling chosen by configuration name; every pooler is DataFrame -> DataFrame."""
    if name not in POOLERS:
        raise ValueError(f"unknown pooling {name!r}; choose from {sorted(POOLERS)}")
    return POOLERS[name](states, layer, **kw)
