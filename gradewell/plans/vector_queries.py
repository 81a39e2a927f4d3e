"""Vector functions, feature concatenation and pooling over the token-state view.

token_states: doc = vec_id div 16, pos = vec_id mod 16, layer l = the l-th
16-value slice of the embedding, mask = 1 when pos < 4 + doc mod 13.
Vectors are compared in long form ``(id, dim, value)``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.functions import vectors as vf
from gradewell.operators import pooling as po
from gradewell.plans.common import r6
from gradewell.plans.registry import QUERIES, query
from gradewell.sources import tables

T = ("quality", "toxic")
WIDTH, LAYERS, LAST = 16, 4, 3
LAYER_START = 1
HALVING = vf.halving_weights(LAST, LAYER_START)       # {1: .25, 2: .5, 3: 1}
N_OUT = 6                                               # width of the reference's pooling heads
Q_VEC = vf.seeded_normal(11, (WIDTH,))
W_H = vf.seeded_normal(12, (WIDTH, N_OUT))
HEAD_W = vf.seeded_normal(13, (64, len(T)))
HEAD_B = vf.seeded_normal(14, (len(T),))
BS_A = vf.seeded_normal(15, (len(HALVING),))
BS_A0 = float(vf.seeded_normal(16, (1,))[0])
BS_B = vf.seeded_normal(17, (WIDTH, N_OUT))
BS_B0 = vf.seeded_normal(18, (N_OUT,))
BATCH = 4

SQL_EMB = """
  SELECT vec_id, CAST(i - 1 AS INTEGER) AS dim, CAST(embedding[i] AS DOUBLE) AS x
  FROM embeddings CROSS JOIN range(1, 65) t(i)"""

SQL_TS = f"""
  SELECT vec_id // 16 AS doc_id, CAST(vec_id % 16 AS INTEGER) AS pos,
         CAST((i - 1) // {WIDTH} AS INTEGER) AS layer, CAST((i - 1) % {WIDTH} AS INTEGER) AS dim,
         CAST(embedding[i] AS DOUBLE) AS x,
         CASE WHEN vec_id % 16 < 4 + (vec_id // 16) % 13 THEN 1 ELSE 0 END AS mask
  FROM embeddings CROSS JOIN range(1, 65) t(i)"""


def _values(rows, cols: str) -> str:
    body = ", ".join("(" + ", ".join(f"CAST({float(v)!r} AS DOUBLE)" if isinstance(v, (float, np.floating))
                                     else str(v)
                                     for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({cols})"


def _matrix_values(m: np.ndarray, cols: str = "dim, j, w") -> str:
    return _values([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], cols)


def _layer_w_sql() -> str:
    return _values([(l, w) for l, w in HALVING.items()], "layer, lw")


def _states(spark, sf):
    return tables.token_states(spark, sf, layers=LAYERS, width=WIDTH)


def _long(vecs, key="doc_id"):
    return po.to_long(vecs, key).select(key, "dim", r6("value").alias("value"))


# ---------------------------------------------------------------- scalar vector ops

@query("l2_normalised", "G8 G14", sql=f"""
WITH e AS ({SQL_EMB}), n AS (SELECT vec_id, sqrt(sum(x * x)) AS nrm FROM e GROUP BY vec_id)
SELECT e.vec_id, e.dim, round(e.x / greatest(n.nrm, 1e-12), 6) AS value
FROM e JOIN n ON e.vec_id = n.vec_id""")
def l2_normalised(spark, sf):
    emb = tables.table(spark, sf, "embeddings")
    v = emb.select("vec_id", vf.l2_normalise(F.col("embedding").cast("array<double>")).alias("vec"))
    return _long(v, "vec_id")


@query("feature_concat", "C7 C6 G8", sql=f"""
WITH e AS (SELECT vec_id, dim // 16 AS block, dim % 16 AS d, x FROM ({SQL_EMB})),
     n AS (SELECT vec_id, block, sqrt(sum(x * x)) AS nrm FROM e GROUP BY vec_id, block)
SELECT e.vec_id, CAST(e.block * 16 + e.d AS INTEGER) AS dim, round(e.x / greatest(n.nrm, 1e-12), 6) AS value
FROM e JOIN n ON e.vec_id = n.vec_id AND e.block = n.block""")
def feature_concat(spark, sf):
    """Four 16-d blocks per id stored long (one row per encoder block), each
    normalised, concatenated in block order by key."""
    from gradewell.operators.features import hconcat

    emb = tables.table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("e"))
    blocks = emb.select("vec_id", F.inline(F.array(*[
        F.struct(F.lit(b).alias("block"), vf.l2_normalise(F.slice("e", b * 16 + 1, 16)).alias("vec"))
        for b in range(4)])))
    return _long(hconcat(blocks, "vec_id", n_blocks=4), "vec_id")


@query("linear_head", "G11", sql=lambda: f"""
WITH e AS ({SQL_EMB}), w AS (SELECT * FROM {_matrix_values(HEAD_W)}),
     b AS (SELECT * FROM {_values([(j, float(HEAD_B[j])) for j in range(len(T))], 'j, bias')}),
     t AS (SELECT * FROM {_values([(j, repr(t)) for j, t in enumerate(T)], 'j, target')})
SELECT e.vec_id, t.target, round(sum(e.x * w.w) + min(b.bias), 6) AS score
FROM e JOIN w ON e.dim = w.dim JOIN b ON w.j = b.j JOIN t ON t.j = w.j
GROUP BY e.vec_id, t.target""")
def linear_head(spark, sf):
    return _head(spark, sf).select("vec_id", "target", r6("score").alias("score"))


def _head(spark, sf):
    emb = tables.table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("e"))
    outs = vf.affine(F.col("e"), HEAD_W, HEAD_B)
    pairs = F.array(*[F.struct(F.lit(t).alias("target"), o.alias("score")) for t, o in zip(T, outs)])
    return emb.select("vec_id", F.inline(pairs))


@query("scaled_sigmoid", "G10", sql=lambda: f"""
WITH e AS ({SQL_EMB}), w AS (SELECT * FROM {_matrix_values(HEAD_W)}),
     b AS (SELECT * FROM {_values([(j, float(HEAD_B[j])) for j in range(len(T))], 'j, bias')}),
     t AS (SELECT * FROM {_values([(j, repr(t)) for j, t in enumerate(T)], 'j, target')}),
     s AS (SELECT e.vec_id, t.target, sum(e.x * w.w) + min(b.bias) AS score
           FROM e JOIN w ON e.dim = w.dim JOIN b ON w.j = b.j JOIN t ON t.j = w.j GROUP BY e.vec_id, t.target)
SELECT vec_id, target, round(4.0 / (1.0 + exp(-score)) + 1.0, 6) AS grade FROM s""")
def scaled_sigmoid(spark, sf):
    h = _head(spark, sf)
    return h.select("vec_id", "target", r6(vf.scaled_sigmoid(F.col("score"))).alias("grade"))


@query("softmax_layers", "G9 G13 I9", sql=lambda: f"""
WITH s AS (SELECT doc_id, layer, avg(x) AS score FROM ({SQL_TS}) WHERE pos = 0 GROUP BY doc_id, layer),
     m AS (SELECT *, exp(score - max(score) OVER (PARTITION BY doc_id)) AS ex FROM s)
SELECT m.doc_id, m.layer, round(ex / sum(ex) OVER (PARTITION BY m.doc_id), 6) AS weight,
       coalesce(v.lw, 0.0) AS halving_weight
FROM m LEFT JOIN {_layer_w_sql()} ON m.layer = v.layer""")
def softmax_layers(spark, sf):
    s = _states(spark, sf).where(F.col("pos") == 0).select(
        "doc_id", "layer", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("_sum"),
        F.size("vec").alias("_n"))
    s = s.withColumn("score", F.col("_sum") / F.col("_n"))
    hw = po._layer_weight(HALVING)
    return s.select("doc_id", "layer", r6(po.softmax(F.col("score"), ["doc_id"])).alias("weight"),
                    hw.alias("halving_weight"))


# ---------------------------------------------------------------- pooling

@query("pool_mean", "I1", sql=f"""
SELECT doc_id, dim, round(sum(mask * x) / greatest(sum(mask), 1e-9), 6) AS value
FROM ({SQL_TS}) WHERE layer = {LAST} GROUP BY doc_id, dim""")
def pool_mean(spark, sf):
    return _long(po.mean_pool(_states(spark, sf), LAST))


@query("pool_max", "I2 G15", sql=f"""
SELECT doc_id, dim, round(max(CASE WHEN mask = 1 THEN x ELSE -1e4 END), 6) AS value
FROM ({SQL_TS}) WHERE layer = {LAST} GROUP BY doc_id, dim""")
def pool_max(spark, sf):
    return _long(po.max_pool(_states(spark, sf), LAST))


@query("pool_min", "I3 G15", sql=f"""
SELECT doc_id, dim, round(min(x), 6) AS value
FROM ({SQL_TS}) WHERE layer = {LAST} AND mask = 1 GROUP BY doc_id, dim""")
def pool_min(spark, sf):
    return _long(po.min_pool(_states(spark, sf), LAST))


@query("pool_first", "I9", sql=f"""
SELECT doc_id, dim, round(x, 6) AS value FROM ({SQL_TS}) WHERE layer = {LAST} AND pos = 0""")
def pool_first(spark, sf):
    return _long(po.first_token(_states(spark, sf), LAST))


@query("pool_weighted_layer", "I6 G13", sql=lambda: f"""
SELECT t.doc_id, t.dim, round(sum(v.lw * t.mask * t.x) / sum(v.lw * t.mask), 6) AS value
FROM ({SQL_TS}) t JOIN {_layer_w_sql()} ON t.layer = v.layer
GROUP BY t.doc_id, t.dim""")
def pool_weighted_layer(spark, sf):
    return _long(po.weighted_layer_pool(_states(spark, sf), HALVING))


@query("pool_mixed", "I7 G13", sql=lambda: f"""
WITH p AS (SELECT doc_id, layer, dim, sum(mask * x) / greatest(sum(mask), 1e-9) AS m
           FROM ({SQL_TS}) GROUP BY doc_id, layer, dim)
SELECT p.doc_id, p.dim, round(sum(v.lw * p.m) / sum(v.lw), 6) AS value
FROM p JOIN {_layer_w_sql()} ON p.layer = v.layer GROUP BY p.doc_id, p.dim""")
def pool_mixed(spark, sf):
    return _long(po.mixed_pool(_states(spark, sf), HALVING))


@query("pool_layer_attention", "I5 G9 G11", sql=lambda: f"""
WITH f AS (SELECT doc_id, layer, dim, x FROM ({SQL_TS}) WHERE pos = 0 AND layer >= {LAYER_START}),
     q AS (SELECT * FROM {_values([(d, float(Q_VEC[d])) for d in range(WIDTH)], 'dim, q')}),
     s AS (SELECT f.doc_id, f.layer, sum(f.x * q.q) AS score FROM f JOIN q ON f.dim = q.dim GROUP BY 1, 2),
     e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY doc_id)) AS ex FROM s),
     a AS (SELECT doc_id, layer, ex / sum(ex) OVER (PARTITION BY doc_id) AS a FROM e),
     c AS (SELECT f.doc_id, f.dim, sum(a.a * f.x) AS ctx FROM f JOIN a ON f.doc_id = a.doc_id AND f.layer = a.layer
           GROUP BY 1, 2),
     w AS (SELECT * FROM {_matrix_values(W_H)})
SELECT c.doc_id, CAST(w.j AS INTEGER) AS dim, round(sum(c.ctx * w.w), 6) AS value
FROM c JOIN w ON c.dim = w.dim GROUP BY c.doc_id, w.j""")
def pool_layer_attention(spark, sf):
    layers = list(range(LAYER_START, LAST + 1))
    return _long(po.layer_attention(_states(spark, sf), Q_VEC, W_H, layers))


@query("pool_batch_softmax", "I8 G9 G10", sql=lambda: f"""
WITH p AS (SELECT doc_id, layer, dim, sum(mask * x) / greatest(sum(mask), 1e-9) AS m
           FROM ({SQL_TS}) WHERE layer >= {LAYER_START} GROUP BY doc_id, layer, dim),
     e AS (SELECT *, exp(m - max(m) OVER (PARTITION BY doc_id // {BATCH}, layer, dim)) AS ex FROM p),
     s AS (SELECT *, ex / sum(ex) OVER (PARTITION BY doc_id // {BATCH}, layer, dim) AS sm FROM e),
     la AS (SELECT * FROM {_values([(l, float(BS_A[i])) for i, l in enumerate(HALVING)], 'layer, a')}),
     z AS (SELECT s.doc_id, s.dim, sum(la.a * s.sm) + {BS_A0!r} AS z FROM s JOIN la ON s.layer = la.layer GROUP BY 1, 2),
     w AS (SELECT * FROM {_matrix_values(BS_B)}),
     b AS (SELECT * FROM {_values([(j, float(BS_B0[j])) for j in range(N_OUT)], 'j, b0')}),
     o AS (SELECT z.doc_id, w.j, sum(z.z * w.w) + min(b.b0) AS o FROM z JOIN w ON z.dim = w.dim JOIN b ON b.j = w.j
           GROUP BY 1, 2)
SELECT doc_id, CAST(j AS INTEGER) AS dim, round(4.0 / (1.0 + exp(-o)) + 1.0, 6) AS value FROM o""")
def pool_batch_softmax(spark, sf):
    layers = list(HALVING)
    return _long(po.batch_softmax_head(_states(spark, sf), layers, BATCH, BS_A, BS_A0, BS_B, BS_B0))


ATTENTION = po.attention_params(21, WIDTH)


def _sql_erf(x: str) -> str:
    """erf(x) = exp(-x^2) * sum over n of x^(2n+1) / gamma(n + 3/2); all terms have one sign."""
    size = f"greatest(abs({x}), 1e-300)"
    return (f"sign({x}) * list_sum(list_transform(range(160), "
            f"lambda n: exp((2 * n + 1) * ln({size}) - lgamma(n + 1.5) - {x} * {x})))")


@query("pool_attention", "I4 G12 K2", sql=lambda: f"""
WITH s AS (SELECT * FROM ({SQL_TS}) WHERE layer = {LAST} AND mask = 1),
     w AS (SELECT * FROM {_matrix_values(ATTENTION['w1'])}),
     u AS (SELECT * FROM {_values([(j, float(ATTENTION['b1'][j]), float(ATTENTION['w2'][j])) for j in range(WIDTH)],
                                  'j, b1, w2')}),
     h AS (SELECT s.doc_id, s.pos, w.j, sum(s.x * w.w) + min(u.b1) AS h, min(u.w2) AS w2
           FROM s JOIN w ON s.dim = w.dim JOIN u ON u.j = w.j GROUP BY 1, 2, 3),
     z AS (SELECT doc_id, pos, w2, (h - avg(h) OVER p) / sqrt(var_pop(h) OVER p + 1e-5) AS z
           FROM h WINDOW p AS (PARTITION BY doc_id, pos)),
     e AS (SELECT doc_id, pos, w2, z, z / sqrt(2.0) AS r FROM z),
     g AS (SELECT doc_id, pos, sum(w2 * 0.5 * z * (1.0 + {_sql_erf('r')})) + {ATTENTION['b2']!r} AS score
           FROM e GROUP BY 1, 2),
     x AS (SELECT doc_id, pos, exp(score - max(score) OVER (PARTITION BY doc_id)) AS ex FROM g),
     a AS (SELECT doc_id, pos, ex / sum(ex) OVER (PARTITION BY doc_id) AS a FROM x)
SELECT s.doc_id, s.dim, round(sum(a.a * s.x), 6) AS value
FROM s JOIN a ON s.doc_id = a.doc_id AND s.pos = a.pos GROUP BY s.doc_id, s.dim""")
def pool_attention(spark, sf):
    """MLP-scored attention pooling with the exact GELU; the SQL twin takes erf by its series."""
    return _long(po.attention_pool(_states(spark, sf), LAST, ATTENTION))


#: Each pooling name with the query that shows it alone.
SELECTOR = {"mean": "pool_mean", "max": "pool_max", "min": "pool_min", "first": "pool_first",
            "weightedlayer": "pool_weighted_layer", "mixed": "pool_mixed", "attention": "pool_attention",
            "attention_sup": "pool_layer_attention", "absurd": "pool_batch_softmax"}


@query("pool_selector", "I10 K6", sql=lambda: " UNION ALL ".join(
    f"SELECT '{name}' AS pooling, doc_id, dim, value FROM ({QUERIES[q].sql})" for name, q in SELECTOR.items()))
def pool_selector(spark, sf):
    """Every pooler chosen by its configuration name."""
    states = _states(spark, sf)
    layers = list(HALVING)
    settings = {"weights": HALVING, "params": ATTENTION, "q": Q_VEC, "w_h": W_H, "layers": layers,
                "head": {"layers": layers, "batch_size": BATCH, "a": BS_A, "a0": BS_A0, "b": BS_B, "b0": BS_B0}}
    # max and min take a fill value among their own settings, so they get none of these
    parts = [_long(po.pool(states, name, LAST, **({} if name in ("max", "min") else settings)))
             .withColumn("pooling", F.lit(name)) for name in SELECTOR]
    return reduce(DataFrame.unionByName, parts).select("pooling", "doc_id", "dim", "value")
