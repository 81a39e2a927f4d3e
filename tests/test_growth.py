"""Steps whose rows, bytes or passes must not outgrow their input."""

import random

from pyspark.sql import functions as F

from gradewell.operators import containment


# ------------------------------------------------------------------ containment

def test_candidates_stay_near_the_matches_where_words_recur(spark):
    """Texts of a few words share all short grams; a pattern's candidates are still the
    texts that hold it, and the patterns travel, not the texts."""
    rng = random.Random(6)
    words = [a + b for a in ("above", "tween", "carri", "stanc") for b in ("ing", "er", "ment", "ly")]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(120)]
    spots = [(rng.randrange(120), rng.randrange(2000)) for _ in range(100)]
    pats = [texts[i][a:a + 61] for i, a in spots]
    docs = spark.createDataFrame(list(enumerate(texts)), "_tk long, _t string")
    rows = spark.createDataFrame(list(enumerate(pats)), "_pk long, _p string")
    found = containment._candidates(rows, docs)
    assert {(i, k) for k, (i, _) in enumerate(spots)} <= {(r["_tk"], r["_pk"]) for r in found.collect()}
    assert found.count() < 3 * len(pats), found.count()

    pairs = containment.contained_pairs(rows.select("_pk", F.col("_p").alias("text")), docs.select("_tk", F.col("_t").alias("text")),
                                        "_pk", "_tk")
    joins = [line for line in pairs._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
    assert sum("Contains" in line for line in joins) == 1 and "Contains" in joins[0]    # the texts come in last


def test_containment_of_patterns_of_every_length(spark):
    rng = random.Random(8)
    whole = " ".join(rng.choice(["ab", "abc", "ünd", "be"]) for _ in range(900))
    docs = [(i, whole[a:a + 200]) for i, a in enumerate(range(0, 2400, 170))] + [(99, None), (100, "")]
    pats = [whole[a:a + n] for n in range(0, 90) for a in (rng.randrange(2000),)] + [None, "zq"]
    pats += [p[:-1] + "!" for p in pats if p]
    d = spark.createDataFrame(docs, "doc long, text string")
    p = spark.createDataFrame(list(enumerate(pats)), "pat long, text string")
    want = sorted((i, k) for i, t in docs for k, x in enumerate(pats) if t and x and x in t)
    assert sorted(map(tuple, containment.contained_pairs(p, d, "pat", "doc").collect())) == want
    both = p.withColumn("side", F.when(F.col("pat") % 2 == 0, "even").otherwise("odd"))
    got = containment.joined_share(both, d, "pat", ["doc", "text"], by=["side"], size=64)
    joined = " ".join(t or "" for _, t in docs)
    for r in got.collect():
        mine = pats[r["side"] == "odd"::2]
        assert (r["n_total"], r["n_found"]) == (len(mine), sum(bool(x) and x in joined for x in mine))


# ------------------------------------------------------------------ streams

def test_hours_of_a_stream_are_summarised_many_at_a_time(spark, tmp_path):
    """No Python call for each (run, hour): most hours have one row. Values equal those of each hour alone."""
    from gradewell.streaming import stateful

    rng = random.Random(3)
    rows = [(run, i, 3_600_000_000 * (i // 2) + rng.randrange(3_600) * 1_000_000 if i % 7 else None,
             rng.choice([None, float("nan"), float(rng.randrange(9))]), rng.choice([None, 1, 4])) for run in (1, 2, None) for i in range(40)]
    log = spark.createDataFrame(rows, "run long, event_id long, us long, val double, n int").select(
        "run", F.timestamp_micros("us").alias("ts"), "event_id", "val", "n")
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    assert "InPandasWithState" not in stateful.hourly(stream)._jdf.queryExecution().logical().toString()
    got = {(r["run"], r["hour"]): r for r in stateful.drain(spark, stream).collect()}
    hours = {}
    for r in log.select("*", F.date_trunc("hour", "ts").alias("hour")).collect():
        hours.setdefault((r["run"], r["hour"]), []).append(r)
    assert got.keys() == hours.keys()
    for key, held in hours.items():
        held.sort(key=lambda r: (r["ts"] or 0, r["event_id"]) if r["ts"] else (0, r["event_id"]))
        val = [r["val"] if r["val"] == r["val"] else None for r in held]
        best = [i for i, v in enumerate(val) if v is not None and all(x is None or x > v for x in val[:i])]
        assert (got[key]["n_updates"], got[key]["n_val"]) == (len(held), sum(v is not None for v in val))
        assert (got[key]["offsets"], got[key]["values"]) == (best, [val[i] for i in best])
        assert got[key]["val_n"] == sum(v * r["n"] for v, r in zip(val, held) if v is not None and r["n"] is not None)
        assert got[key]["n"] == sum(r["n"] or 0 for r in held) and got[key]["val"] == sum(v or 0 for v in val)


# ------------------------------------------------------------------ sequences

def test_padded_batches_sort_lengths_without_the_ids(spark):
    """The same batches and arrays as over whole rows, also among repeated and null ids, and
    no window or sort over the ids."""
    from gradewell.operators import sequences as sq

    rows = [(i if i % 5 else None, n, list(range(4, 4 + min(n, 8)))) for i, n in enumerate([3, 0, 12, 7, 7, 9, 1, 30, 2, 8, 8, 5, 4])]
    encoded = spark.createDataFrame(rows, "doc_id long, n_tokens int, ids array<int>")
    got = sq.padded_batches(encoded, 4, 10)
    whole = sq.pad_to_longest(sq.length_batches(encoded.withColumn("token_length", F.col("n_tokens") + 2), 4), 10)
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect())) and got.count() == len(rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not any("ids#" in line for line in plan if "Window" in line)


def test_large_vocabularies_are_joined_by_chunk_words_only(spark):
    from gradewell.operators import sequences as sq

    docs = spark.createDataFrame([(i, "a b a c " * 40 + f"w{i}") for i in range(64)], "doc_id long, text string").coalesce(1)
    vocab = sq.build_vocab(sq.token_rows(docs))
    got = sq.encode_ids(docs, vocab, 200, most=0, docs_per_chunk=16)
    assert sorted(map(str, got.collect())) == sorted(map(str, sq.encode_ids(docs, vocab, 200).collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(_toks" not in plan and "posexplode(_words" in plan


def test_hashed_words_and_wide_rows(spark):
    import zlib

    from gradewell.operators import wide

    texts = [None, "", "The the cat", "a b c " * 300, "ünï É é"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, t string")
    encoded = wide.hashed_words(docs, "k", "t", 64)
    for r in encoded.collect():
        words = (texts[r["id"]] or "").lower().split()
        want = {}
        for w in words:
            at = zlib.crc32(w.encode()) % 64
            want[at] = want.get(at, 0) + 1
        assert r["indices"] == sorted(want)
        assert all(abs(v * v - want[i] / len(words)) < 1e-12 for i, v in zip(r["indices"], r["values"]))
    rows = encoded.withColumn("fold", (F.col("id") % 2).cast("int")).withColumn("y", F.col("id").cast("double"))
    model = wide.ridge_cells(rows, ["y"], 2, 64, lam=1.0)
    out = wide.predict_rows(rows, model, keep=["id"])
    assert out.columns == ["id", "target", "pred"] and out.count() == 5
    assert "indices" not in str(out._jdf.queryExecution().analyzed().output())


# ------------------------------------------------------------------ trees

def test_leaves_are_found_by_one_comparison_a_node():
    """Equal to walking down row by row, and without index arrays of all rows for each level."""
    import tracemalloc

    import numpy as np

    from gradewell.operators import trees

    rng = np.random.default_rng(5)
    bins = rng.integers(0, 16, (500, 6)).astype(np.uint8)
    tree = trees.Tree()
    leaves = [0]
    for _ in range(9):
        node = leaves.pop(int(rng.integers(len(leaves))))
        leaves += tree.split(node, int(rng.integers(6)), int(rng.integers(15)), (float(rng.normal()), float(rng.normal())))

    def walk(row):
        node = 0
        while tree.feature[node] >= 0:
            node = (tree.right if row[tree.feature[node]] > tree.cut[node] else tree.left)[node]
        return node

    assert tree.leaves(bins).tolist() == [walk(row) for row in bins]
    assert trees.Tree().leaves(bins).tolist() == [0] * 500 and len(tree.leaves(bins[:0])) == 0
    many = np.repeat(bins, 400, axis=0)
    tracemalloc.start()
    tree.leaves(many)
    assert tracemalloc.get_traced_memory()[1] < 28 * len(many)
    tracemalloc.stop()
