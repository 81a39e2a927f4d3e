"""Containment of short and repeated texts, batches over sparse ids, padded arrays, keyed pseudo labels."""

from __future__ import annotations

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from gradewell.operators import containment, pooling, pseudo, rowindex
from gradewell.operators import sequences as sq


def test_containment_many_short_patterns_and_repeated_texts(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcé"), n)) for n in rng.integers(1, 9, 400)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(25)]
    docs = [(i, texts[i % 25]) for i in range(50)] + [(50, ""), (51, None)]
    cuts = [t[a:a + n] for t in texts for a, n in zip(rng.integers(0, 80, 12), rng.integers(1, 40, 12))]
    pats = [(i, p) for i, p in enumerate([*cuts, *words, "not there at all", "zzz", "", *words[:5]])] + [(9000, None)]
    p = spark.createDataFrame(pats, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = [tuple(r) for r in containment.contained_pairs(p, d, "item_id", "doc_id").collect()]
    brute = {(i, j) for i, t in docs for j, q in pats if t is not None and q and q in t}
    assert len(got) == len(set(got)) and set(got) == brute
    share = containment.containment_share(p, d, "item_id", "doc_id").first()
    assert (share.n_total, share.n_found) == (len(pats), len({j for _, j in brute}))
    none = containment.containment_share(p.limit(0), d, "item_id", "doc_id").first()
    assert (none.n_total, none.n_found, none.ratio) == (0, 0, None)


@pytest.mark.parametrize("ids", ["sparse", "clustered"])
def test_batches_over_sparse_and_clustered_ids(spark, monkeypatch, ids):
    monkeypatch.setattr(rowindex, "BUCKET_ROWS", 50)
    values = [i * 1_000_003 for i in range(600)] if ids == "sparse" else [*range(599), 2**60]
    rows = [(v, 2 + v % 3) for v in values]
    df = spark.createDataFrame(rows + [(None, 3)], "doc_id long, token_length int")
    ranged = rowindex.range_bucket(df, "doc_id", "b")
    counts = [r["count"] for r in ranged.where("doc_id is not null").groupBy("b").count().collect()]
    assert 6 <= len(counts) <= 24 and max(counts) <= 200
    got = {r.doc_id: r.batch_id for r in sq.length_batches(df, 16).collect()}
    order = sorted([*rows, (None, 3)], key=lambda r: (r[1], r[0] is not None, r[0] or 0))
    assert got == {d: i // 16 for i, (d, _) in enumerate(order)}
    unsorted = {r.doc_id: r.batch_id for r in sq.id_batches(df, 16).collect()}
    assert unsorted == {d: i // 16 for i, d in enumerate([None, *values])}


def test_padded_arrays_have_their_batch_width(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, ""), (3, "a b c d e f g h"), (4, None)], "doc_id long, text string")
    encoded = sq.encode_ids(docs, sq.build_vocab(sq.token_rows(docs)), 6)
    batched = sq.length_batches(encoded.withColumn("token_length", F.col("n_tokens") + 2), 2)
    out = {r.doc_id: r for r in sq.pad_to_longest(batched, 6).collect()}
    assert out[2].input_ids == [sq.CLS, sq.SEP] and out[4].attention_mask == [1, 1]
    assert len(out[1].input_ids) == len(out[3].input_ids) == 6       # cut to six, padded to six
    assert out[1].input_ids[3:] == [sq.SEP, sq.PAD, sq.PAD] and out[1].attention_mask == [1, 1, 1, 1, 0, 0]
    assert out[3].input_ids[0] == sq.CLS and out[3].input_ids[5] == sq.SEP


def test_pseudo_rows_carry_their_text_and_are_never_held_out(spark):
    train = spark.createDataFrame([(1, 0, 1.0, "one"), (2, 1, 2.0, "two")],
                                  "text_id long, fold int, g double, full_text string")
    labels = spark.createDataFrame([(0, 10, 5.0), (1, 10, 6.0)], "fold int, text_id long, g double")
    texts = spark.createDataFrame([(10, "ten"), (1, "one"), (2, "two")], "text_id long, full_text string")
    out = {(r.fold, r.text_id): r for r in pseudo.augment(train, labels, texts, "fold", ["g"], "full_text").collect()}
    assert {k: (r.role, r.g, r.full_text) for k, r in out.items()} == {
        (0, 2): ("train", 2.0, "two"), (1, 1): ("train", 1.0, "one"),
        (0, 10): ("pseudo", 5.0, "ten"), (1, 10): ("pseudo", 6.0, "ten")}
    held = {(r.fold, r.text_id) for r in train.collect()}
    assert not held & set(out)


def test_erf_series():
    x = np.concatenate([np.linspace(-8, 8, 4001), [0.0, 1e-12]])
    assert np.allclose(pooling._erf(x), [math.erf(v) for v in x], atol=1e-13)


def test_unknown_pooling_is_refused(spark):
    with pytest.raises(ValueError):
        pooling.pool(spark.range(1), "nothing", 0)
