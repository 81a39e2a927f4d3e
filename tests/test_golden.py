"""Hand-computed golden micro-fixtures (see FIXTURES.md section 3)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewell.functions import losses
from gradewell.functions import vectors as vf
from gradewell.operators import ensemble, fragments, logs, metrics, pooling, pseudo


def test_golden_grades_fold_mean_vs_pooled(spark):
    rows = [(0, "a", 1.0, 2.0), (0, "a", 2.0, 2.0), (1, "a", 3.0, 5.0), (1, "a", 4.0, 4.0),
            (0, "b", 1.0, 1.0), (0, "b", 2.0, 4.0), (1, "b", 3.0, 3.0), (1, "b", 4.0, 4.0)]
    long = spark.createDataFrame(rows, "fold int, target string, y double, pred double")
    cv = {(r.scope, r.target): r.score for r in metrics.cv_scores(metrics.error_table(long)).collect()}
    # per fold rmse: a: f0 sqrt(1/2), f1 sqrt(4/2); b: f0 sqrt(4/2), f1 0
    a0, a1, b0, b1 = math.sqrt(0.5), math.sqrt(2.0), math.sqrt(2.0), 0.0
    assert cv[("fold_mean", "a")] == pytest.approx((a0 + a1) / 2)
    assert cv[("fold_mean", "mcrmse")] == pytest.approx(((a0 + b0) / 2 + (a1 + b1) / 2) / 2)
    assert cv[("pooled", "a")] == pytest.approx(math.sqrt(5 / 4))
    assert cv[("pooled", "mcrmse")] == pytest.approx((math.sqrt(5 / 4) + math.sqrt(4 / 4)) / 2)
    assert cv[("pooled", "mcrmse")] != pytest.approx(cv[("fold_mean", "mcrmse")])


def test_golden_losses(spark):
    df = spark.createDataFrame([(d,) for d in [0.0, 0.5, -0.5, 1.0, -1.0, 2.0, -2.0]], "d double")
    out = df.select("d", losses.smooth_l1(F.col("d")).alias("s"), losses.root_se(F.col("d")).alias("r")).collect()
    expect = {0.0: 0.0, 0.5: 0.125, -0.5: 0.125, 1.0: 0.5, -1.0: 0.5, 2.0: 1.5, -2.0: 1.5}
    for r in out:
        assert r.s == pytest.approx(expect[r.d])
        assert r.r == pytest.approx(math.sqrt(r.d * r.d + 1e-9))


def test_golden_fragments_merge(spark):
    rows = [(7, 2, "c\u0007d"), (7, 0, "a\nb"), (7, 1, "  x\t y  "), (8, 0, "solo")]
    df = spark.createDataFrame(rows, "id long, ord long, text string")
    got = {r.id: r.merged_text for r in fragments.merge_fragments(df, chunk=2).collect()}
    # join by space in order, newline/BEL -> space, collapse space runs, keep tabs, no trim
    assert got[7] == "a b x\t y c d"
    assert got[8] == "solo"


def _states(spark):
    rows = []
    for doc in (0, 1):
        for layer in (0, 1):
            for pos in range(3):
                mask = 0 if pos == 2 else 1
                vec = [1000.0, -1000.0] if mask == 0 else [doc + layer + pos, -(doc + pos)]
                rows.append((doc, layer, pos, mask, [float(v) for v in vec]))
    return spark.createDataFrame(rows, "doc_id long, layer int, pos int, mask int, vec array<double>")


def test_golden_states_pooling(spark):
    st = _states(spark)
    mean = {r.doc_id: r.vec for r in pooling.mean_pool(st, 1).collect()}
    assert mean[0] == pytest.approx([1.5, -0.5])
    assert mean[1] == pytest.approx([2.5, -1.5])
    mx = {r.doc_id: r.vec for r in pooling.max_pool(st, 1).collect()}
    assert mx[0] == pytest.approx([2.0, 0.0])
    mn = {r.doc_id: r.vec for r in pooling.min_pool(st, 1).collect()}
    assert mn[0] == pytest.approx([1.0, -1.0])
    mn_fill = {r.doc_id: r.vec for r in pooling.min_pool(st, 1, fill=1e-4).collect()}
    assert mn_fill[0] == pytest.approx([1e-4, -1.0])        # padding wins with the reference fill
    w = {0: 0.5, 1: 1.0}
    wl = {r.doc_id: r.vec for r in pooling.weighted_layer_pool(st, w).collect()}
    mx2 = {r.doc_id: r.vec for r in pooling.mixed_pool(st, w).collect()}
    for d in (0, 1):
        assert wl[d] == pytest.approx(mx2[d])               # I6 == I7 for token-linear pools


def test_golden_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.0],), ([3.0, 4.0, 0.0],)], "v array<double>")
    out = [r.n for r in df.select(vf.l2_normalise(F.col("v")).alias("n")).collect()]
    assert out[0] == [0.0, 0.0, 0.0]
    assert out[1] == pytest.approx([0.6, 0.8, 0.0])


def test_golden_metrics_best_epoch_tie_and_plateau(spark):
    scores = spark.createDataFrame(
        [(1, 0, 0.9), (1, 1, 0.5), (1, 2, 0.5), (1, 3, 0.6), (1, 4, 0.7), (1, 5, 0.7)],
        "run int, epoch int, score double")
    b = logs.best_epoch(scores).first()
    assert b.best_epoch == 1 and b.best_score == 0.5 and b.n_improvements == 2


def test_golden_metrics_early_stop(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    vals = [5.0, 4.0, 4.5, 4.2, 4.1, 4.3, 4.4, 3.0]
    rows = [(1, t0 + dt.timedelta(minutes=40 * i), i, v, 1) for i, v in enumerate(vals)]
    log = spark.createDataFrame(rows, "run int, ts timestamp_ntz, event_id long, val double, n int")
    e = logs.early_stop(logs.with_steps(log), patience=3).first()
    # best at step 1 (4.0); step 4 is the first with step - 1 >= 3
    assert (e.stopped, e.end_step, e.best_step, e.best_val) == (True, 4, 1, 4.0)
    e2 = logs.early_stop(logs.with_steps(log), patience=10).first()
    assert (e2.stopped, e2.end_step, e2.best_step, e2.best_val) == (False, 7, 7, 3.0)


def test_golden_meter(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0 + dt.timedelta(hours=i), i, v, n) for i, (v, n) in enumerate([(2.0, 1), (4.0, 3), (1.0, 4)])]
    log = spark.createDataFrame(rows, "run int, ts timestamp_ntz, event_id long, val double, n int")
    got = [r.avg for r in logs.running_meter(log).orderBy("event_id").collect()]
    assert got == pytest.approx([2.0, 14 / 4, 18 / 8])
    tot = logs.meter_total(log).first()
    assert tot.last_val == 1.0 and tot.avg == pytest.approx(18 / 8)


def test_golden_submissions_keyed_blend(spark):
    a = [(1, 1.0), (2, 2.0), (3, 3.0)]
    b = [(3, 6.0), (1, 2.0), (2, 4.0)]           # different row order
    subs = spark.createDataFrame([("a", i, v) for i, v in a] + [("b", i, v) for i, v in b],
                                 "model string, text_id long, g double")
    w = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "model string, w double")
    blend = {r.text_id: r.g for r in ensemble.weighted_blend(subs, w, "text_id", ["g"]).collect()}
    assert blend == {1: pytest.approx(1.75), 2: pytest.approx(3.5), 3: pytest.approx(5.25)}
    template = spark.createDataFrame([(1, 3.0), (2, 3.0), (4, 3.0)], "text_id long, g double")
    preds = spark.createDataFrame([(1, 9.0), (2, 8.0)], "text_id long, g double")
    filled = {r.text_id: r.g for r in ensemble.fill_template(template, preds, "text_id", ["g"]).collect()}
    assert filled == {1: 9.0, 2: 8.0, 4: None}


def test_golden_pseudo_only_matching_fold(spark):
    train = spark.createDataFrame([(1, 0, 1.0), (2, 1, 2.0), (3, 2, 3.0)], "text_id long, fold int, g double")
    labels = spark.createDataFrame([(1, 10, 5.0), (0, 11, 6.0)], "fold int, text_id long, g double")
    texts = spark.createDataFrame([(10,), (11,)], "text_id long")
    out = pseudo.augment(train, labels, texts, "fold", ["g"]).collect()
    by_split = {}
    for r in out:
        by_split.setdefault(r.fold, []).append((r.text_id, r.role))
    assert sorted(by_split[1]) == [(1, "train"), (3, "train"), (10, "pseudo")]
    assert sorted(by_split[0]) == [(2, "train"), (3, "train"), (11, "pseudo")]
    # a split never trains on its own validation rows
    for split, members in by_split.items():
        assert all(not (tid == split + 1 and role == "train") for tid, role in members)


def test_golden_paths_and_duplicate_error(spark):
    from gradewell.functions import text as tx
    from gradewell.sources import files

    df = spark.createDataFrame([("/m/deb_gpu0_fold2_best.pth",), ("/m/x/deb_gpu0_fold2_best.bin",)], "path string")
    got = df.select(tx.stem(F.col("path")).alias("s"), tx.artefact_name(F.col("path")).alias("a")).collect()
    assert [r.s for r in got] == ["deb_gpu0_fold2_best"] * 2
    keyed = df.select("path", F.regexp_extract("path", r"_fold(\d+)_", 1).alias("fold"))
    with pytest.raises(Exception):
        files.unique_match(keyed, ["fold"]).collect()


def test_batch_softmax_depends_on_batch_mates(spark):
    st = _states(spark)
    a = np.ones(2)
    b = np.ones((2, 1))
    one = {r.doc_id: r.vec for r in pooling.batch_softmax_head(st, [0, 1], 1, a, 0.0, b, np.zeros(1)).collect()}
    two = {r.doc_id: r.vec for r in pooling.batch_softmax_head(st, [0, 1], 2, a, 0.0, b, np.zeros(1)).collect()}
    assert one[0] != pytest.approx(two[0])


def test_golden_sequences(spark):
    from gradewell.operators import sequences as sq

    docs = spark.createDataFrame([(1, "b a b, c"), (2, "a"), (3, "")], "doc_id long, text string")
    rows = sq.token_rows(docs)
    vocab = {r.token: (r.cnt, r.token_id) for r in sq.build_vocab(rows).collect()}
    # counts: b 2, a 2, ',' 1, c 1 -> order (count desc, token): a, b, ',', c
    assert vocab == {"a": (2, 4), "b": (2, 5), ",": (1, 6), "c": (1, 7)}
    lens = {r.doc_id: (r.n_tokens, r.token_length) for r in sq.lengths(docs).collect()}
    assert lens == {1: (5, 7), 2: (1, 3), 3: (0, 2)}
    encoded = sq.encode_ids(docs, sq.build_vocab(rows), 5)
    seq = sq.truncate_pad_long(encoded, max_len=5).orderBy("doc_id", "pos").collect()
    by_doc = {}
    for r in seq:
        by_doc.setdefault(r.doc_id, []).append((r.input_id, r.attention_mask))
    assert by_doc[1] == [(1, 1), (5, 1), (4, 1), (5, 1), (2, 1)]          # CLS b a b SEP (truncated)
    assert by_doc[2] == [(1, 1), (4, 1), (2, 1), (0, 0), (0, 0)]          # CLS a SEP PAD PAD
    assert by_doc[3] == [(1, 1), (2, 1), (0, 0), (0, 0), (0, 0)]
    arr = sq.truncate_pad_arrays(spark.createDataFrame([([7, 8, 9, 10],)], "ids array<int>"), 4).first()
    assert arr.input_ids == [1, 7, 8, 2] and arr.attention_mask == [1, 1, 1, 1]


def test_golden_length_batches_and_padding(spark):
    from gradewell.operators import sequences as sq

    lens = spark.createDataFrame([(i, l) for i, l in enumerate([5, 3, 9, 3, 7])], "doc_id long, token_length int")
    b = {r.doc_id: (r.rank, r.batch_id) for r in sq.length_batches(lens, 2).collect()}
    # order by (length, id): 1(3) 3(3) 0(5) 4(7) 2(9)
    assert b == {1: (1, 0), 3: (2, 0), 0: (3, 1), 4: (4, 1), 2: (5, 2)}
    p = {r.doc_id: r.padded_length for r in sq.pad_to_longest(sq.length_batches(lens, 2), 8).collect()}
    assert p == {1: 3, 3: 3, 0: 7, 4: 7, 2: 8}


def test_gbt_best_prefix_rule():
    from gradewell.operators.trees import best_prefix

    assert best_prefix([5, 4, 4, 3.5, 3.6, 3.7, 3.8], patience=3) == (3, 6)
    assert best_prefix([5, 4, 4, 4, 4], patience=2) == (1, 3)      # tie keeps the earliest
    assert best_prefix([3, 2, 1], patience=5) == (2, 2)
