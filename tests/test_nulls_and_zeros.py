"""NULL values, zero divisors, graded folds, softmax states and containment across texts."""

import random
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradewell.operators import containment, ensemble, folds, fragments, linear, logs, pooling
from gradewell.plans import common, log_queries
from gradewell.plans.registry import load_all


def same_rows(got, want):
    key = lambda r: tuple((x is not None and x == x, str(x)) for x in r)
    clean = lambda rows: sorted((tuple(None if x is None or x != x else (round(x, 6) if isinstance(x, float) else x)
                                       for x in r) for r in rows), key=key)
    assert clean(got) == clean(want)


# ------------------------------------------------------------------ logs with NULLs

@pytest.fixture(scope="module")
def null_log(spark):
    rng = random.Random(3)
    rows = []
    for run in (1, 2, 3, 4, None):
        for i in range(60):
            value = None if rng.random() < 0.3 or run == 4 or (run == 3 and i < 5) else float(rng.randint(0, 30))
            rows.append((run, datetime(2024, 1, 1) + timedelta(hours=7 * i), 1000 * (run or 0) + i, value,
                         None if rng.random() < 0.1 else rng.randint(0, 3)))
    frame = pd.DataFrame(rows, columns=["run", "ts", "event_id", "val", "n"]).astype({"run": "Int64", "n": "Int64"})
    log = spark.createDataFrame(rows, "run long, ts timestamp_ntz, event_id long, val double, n int").cache()
    return log, frame


@pytest.mark.parametrize("name", ["best_epoch", "best_iteration", "early_stop", "meter_total", "meter_running"])
def test_log_queries_equal_their_twins_on_nulls(spark, null_log, name, monkeypatch):
    log, frame = null_log
    sql = load_all()[name].sql
    sql = (sql() if callable(sql) else sql).replace(log_queries.SQL_LOG, "SELECT * FROM log")
    assert "events" not in sql
    con = duckdb.connect()
    con.register("log", frame)
    want = con.execute(sql).fetchdf().astype(object)
    monkeypatch.setattr(log_queries, "_log", lambda *_: log)
    got = load_all()[name].build(spark, "")
    names = sorted(want.columns)
    want = [tuple(None if pd.isna(x) else x for x in r) for r in want[names].itertuples(index=False)]
    numbers = lambda rows: [tuple(float(x) if isinstance(x, (int, np.integer, float)) and not isinstance(x, bool) else
                                  (str(x) if x is not None and not isinstance(x, (bool, np.bool_)) else
                                   (None if x is None else bool(x))) for x in r) for r in rows]
    same_rows(numbers([tuple(r) for r in got.select(*names).collect()]), numbers(want))


def test_a_run_of_nulls_has_no_best(spark, null_log):
    log, _ = null_log
    best = {r["run"]: r for r in logs.best_epoch(logs.epoch_scores(log)).collect()}
    assert best[4]["best_epoch"] is None and best[4]["n_improvements"] == 0
    steps = logs.with_steps(log, sizes=False)
    end = {r["run"]: r for r in logs.early_stop(steps, 5).collect()}
    assert not end[4]["stopped"] and end[4]["best_step"] is None and end[4]["end_step"] == 59
    assert end[3]["best_val"] is not None


# ------------------------------------------------------------------ zero divisors

def test_overlap_with_an_empty_table(spark):
    some, none = spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([], "id string")
    assert fragments.overlap(some, none).first().asDict() == {"n_common": 0, "n_labelled": 0, "ratio": None}


def test_constant_feature_and_single_fold(spark):
    rows = [(i, 0.1, float(i), i % 2) for i in range(10)]
    flat = spark.createDataFrame(rows, "id long, x double, y double, fold int")
    for r in linear.univariate_fold_fit(flat, "x", ["y"]).collect():
        assert r["b_y"] == 0.0 and abs(r["a_y"] - np.mean([i for i in range(10) if i % 2 != r["fold"]])) < 1e-12
    one, = linear.univariate_fold_fit(flat.withColumn("fold", F.lit(0)), "x", ["y"]).collect()
    assert one["a_y"] is None and one["b_y"] == 0.0


def test_fold_fit_twin_on_a_constant_feature(spark):
    frame = pd.DataFrame({"fold": [0, 0, 1, 1], "x": [0.3] * 4, "quality": [1.0, 0, 1, 1], "toxic": [0.0, 1, 1, 0]})
    con = duckdb.connect()
    con.register("ef", frame)
    want = con.execute(common.sql_coef("x")).fetchdf()
    got = linear.univariate_fold_fit(spark.createDataFrame(frame), "x", ["quality", "toxic"]).toPandas()
    names = sorted(want.columns)
    assert np.allclose(got[names].sort_values("fold").to_numpy(float), want[names].sort_values("fold").to_numpy(float))


def test_blends_without_weight_and_with_a_perfect_model(spark):
    subs = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 4.0), ("c", 1, 9.0)], "model string, text_id long, q double")
    zero = spark.createDataFrame([("a", 1.0), ("b", -1.0)], "model string, w double")
    assert ensemble.weighted_blend(subs, zero, "text_id", ["q"]).first()["q"] is None
    scores = spark.createDataFrame([("a", 0.0), ("b", 0.0), ("c", 0.5)], "model string, score double")
    blend = lambda s: ensemble.weighted_blend(subs, ensemble.inverse_weights(s), "text_id", ["q"]).first()["q"]
    assert blend(scores) == 3.0
    some = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 0.5)], "model string, score double")
    assert abs(blend(some) - (2.0 + 2 * 9.0) / 3) < 1e-12


# ------------------------------------------------------------------ graded folds

def fold_counts(spark, rows, labels, k, seed=1):
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} {t}" for n, t in labels))
    names = [n for n, _ in labels]
    out = df.join(folds.iterative_folds(df, "id", names, k, seed), "id").toPandas()
    assert len(out) == len(rows) and out["id"].is_unique
    return out, names


def test_every_grade_is_within_one_of_its_share(spark):
    rng = random.Random(5)
    rows = [(i, rng.choices([1.0, 1.5, 2.0, 3.0, 5.0], [1, 2, 10, 20, 3])[0], rng.choice([None, 1, 2, 3]),
             rng.choice("xyzuvw")) for i in range(997)]
    for k in (4, 5):
        out, names = fold_counts(spark, rows, [("a", "double"), ("b", "int"), ("c", "string")], k)
        for n in names:
            for _, part in out.groupby(out[n].astype(str)):
                per_fold = part["fold"].value_counts().reindex(range(k), fill_value=0)
                assert (abs(per_fold - len(part) / k) <= 1).all(), (n, per_fold.tolist())
        sizes = out["fold"].value_counts()
        assert sizes.max() - sizes.min() <= 1


def test_grades_that_are_all_positive(spark):
    out, _ = fold_counts(spark, [(i, 1 + i % 5 if i < 180 else 3) for i in range(225)], [("g", "int")], 4)
    for g, part in out.groupby("g"):
        per_fold = part["fold"].value_counts()
        assert per_fold.max() - per_fold.min() <= 1, (g, per_fold.tolist())


def test_folds_of_few_rows_and_of_none(spark):
    out, _ = fold_counts(spark, [(1, 1), (2, 2)], [("g", "int")], 4)
    assert out["fold"].nunique() == 2
    empty = spark.createDataFrame([], "id long, g int")
    assert folds.iterative_folds(empty, "id", ["g"], 4, 1).count() == 0


# ------------------------------------------------------------------ softmax states

def test_attention_states_of_a_long_document_are_merged(spark, monkeypatch):
    rng = np.random.default_rng(6)
    params = pooling.attention_params(3, 8)
    params["w2"] = params["w2"] * 40                      # scores far apart: the shift by the largest matters
    vecs, docs = rng.normal(size=(900, 8)), np.where(np.arange(900) < 700, 0, np.arange(900) % 37)
    rows = [(int(d), 2, i, int(i % 9 != 0), v.tolist()) for i, (d, v) in enumerate(zip(docs, vecs))]
    states = spark.createDataFrame(rows, "doc_id long, layer int, pos int, mask int, vec array<double>").repartition(7)
    score = pooling._attention_scores(**params)(pd.Series(list(vecs))).to_numpy()
    want = {}
    for d in set(docs.tolist()):
        at = (docs == d) & (np.arange(900) % 9 != 0)
        if at.any():
            e = np.exp(score[at] - score[at].max())
            want[d] = (e[:, None] * vecs[at]).sum(0) / e.sum()
    for held, level in ((4096, 64), (3, 64), (4096, 1)):
        monkeypatch.setattr(pooling, "HELD_STATES", held)
        monkeypatch.setattr(pooling, "SINGLE_LEVEL_MAX", level)
        pooled = pooling.attention_pool(states, 2, params)
        got = {r["doc_id"]: r["vec"] for r in pooled.collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[d], want[d]) for d in want)
        plan = pooled._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and plan.count("Aggregate [") == (1 if level == 64 else 2)


# ------------------------------------------------------------------ containment

def test_null_ids_are_matched(spark):
    pats = spark.createDataFrame([(None, "quick brown fox jumps over the lazy dog"), (2, "brown"), (None, "zzz"), (3, None)],
                                 "item_id long, text string")
    docs = spark.createDataFrame([(None, "the quick brown fox jumps over the lazy dog again"), (1, "brown"), (1, "brown"),
                                  (None, None)], "doc_id long, text string")
    got = containment.contained_pairs(pats, docs, "item_id", "doc_id").collect()
    want = [(None, None), (None, 2), (1, 2), (1, 2)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    share = containment.containment_share(pats, docs, "item_id", "doc_id").first()
    assert (share["n_total"], share["n_found"]) == (4, 2)


def test_patterns_across_text_ends(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.choice([0, 1, 3, 40, 900]))) for _ in range(120)]
    docs = spark.createDataFrame([(i, None if i == 7 else t) for i, t in enumerate(texts)], "doc_id long, text string")
    texts[7] = ""
    whole = " ".join(texts)
    spots = [(rng.randrange(len(whole)), rng.choice([1, 5, 30, 200, 1500])) for _ in range(150)]
    pats = [whole[a:a + n] for a, n in spots] + ["".join(rng.choice("abc ") for _ in range(40)) for _ in range(30)] + ["", None]
    patterns = spark.createDataFrame(list(enumerate(pats)), "pat long, text string")
    for size in (64, 5000, 1 << 16):
        blocks = {r["block"]: r["text"] for r in containment.joined_blocks(docs, ["doc_id", "text"], "text", 10, size=size).collect()}
        step = max(size, 10)
        assert blocks == {b: whole[b * step:(b + 1) * step + 10] for b in range(-(-len(whole) // step))}
        row = containment.joined_share(patterns.repartition(3), docs.repartition(5), "pat", ["doc_id", "text"], size=size).first()
        assert (row["n_total"], row["n_found"]) == (182, sum(bool(p) and p in whole for p in pats))
    assert sum(bool(p) and p in whole and not any(p in t for t in texts) for p in pats) > 20


# ------------------------------------------------------------------ token ids

def test_ids_are_looked_up_without_a_row_for_each_token(spark):
    from gradewell.operators import sequences as sq

    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "cat", "sat!", "don't", "ünï"]) + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 60)))
             for _ in range(90)] + [None, "", "zzz unseen"]
    docs = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    vocab = sq.build_vocab(sq.token_rows(docs.where("text not like 'zzz%'"))).cache()
    known = {r["token"]: r["token_id"] for r in vocab.collect()}
    import re
    want = []
    for i, t in enumerate(texts):
        toks = re.findall(r"[^\W_]+|[^\w\s]|_", t or "")
        want.append((i if i % 9 else None, len(toks), [known.get(x, sq.UNK) for x in toks[:20]]))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    for most, per_chunk in ((10_000, 4096), (0, 10)):
        got = sq.encode_ids(docs, vocab, 22, most=most, docs_per_chunk=per_chunk)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
        if most:
            plan = sq.truncate_pad_long(got, 22)._jdf.queryExecution().optimizedPlan().toString()
            assert "Join" not in plan and "Aggregate" not in plan
    long = sq.truncate_pad_long(sq.encode_ids(docs.where("doc_id = 1"), vocab, 22), 22).orderBy("pos").collect()
    n = min(want[1][1], 20)
    assert [r["input_id"] for r in long] == [sq.CLS, *want[1][2], sq.SEP] + [sq.PAD] * (20 - n)
    assert [r["attention_mask"] for r in long] == [1] * (n + 2) + [0] * (20 - n) and [r["pos"] for r in long] == list(range(22))
