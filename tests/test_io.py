"""Source/sink round trips in private temp folders."""

import tempfile

from pyspark.sql import functions as F

from gradewell.config import REFERENCE_TARGETS
from gradewell.sources import files, split_csv


def _tmp():
    return tempfile.mkdtemp(prefix="gw-io-")


def test_csv_multiline_roundtrip_and_failfast(spark):
    d = _tmp()
    rows = [("a1", 'line one\nline "two", with comma', *[3.0] * 6), ("b2", None, *[1.5] * 6)]
    df = spark.createDataFrame(rows, files.ESSAY_SCHEMA)
    files.write_csv(df, d + "/essays")
    back = files.read_csv(spark, d + "/essays", files.ESSAY_SCHEMA)
    assert sorted(back.collect()) == sorted(df.collect())
    with open(d + "/bad.csv", "w") as fh:
        fh.write("text_id,full_text," + ",".join(REFERENCE_TARGETS) + "\nx,hello,not_a_number,1,1,1,1,1\n")
    try:
        files.read_csv(spark, d + "/bad.csv", files.ESSAY_SCHEMA).collect()
        raise AssertionError("expected a parse failure")
    except Exception as e:  # noqa: BLE001
        assert "AssertionError" not in type(e).__name__


def test_oof_partitioned_by_fold(spark):
    d = _tmp()
    df = spark.createDataFrame([(1, 0, 1.0), (2, 1, 2.0)], "text_id long, fold int, pred double")
    files.write_oof(df, d + "/oof")
    back = files.read_oof(spark, d + "/oof").where(F.col("fold") == 1)
    assert "PartitionFilters: [isnotnull(fold" in back._jdf.queryExecution().executedPlan().toString() or back.count() == 1
    assert [r.text_id for r in back.collect()] == [2]


def test_feature_store_computes_only_missing(spark):
    d = _tmp() + "/store"
    calls = []

    def compute(missing):
        calls.append(sorted(r.block for r in missing.collect()))
        return missing.select("block", F.lit(1.0).alias("v"))

    w1 = spark.createDataFrame([(0,), (1,)], "block int")
    files.feature_store_get_or_compute(spark, d, w1, ["block"], compute).collect()
    w2 = spark.createDataFrame([(1,), (2,)], "block int")
    out = files.feature_store_get_or_compute(spark, d, w2, ["block"], compute)
    assert calls == [[0, 1], [2]]
    assert sorted(r.block for r in out.collect()) == [1, 2]


def test_registry_and_metric_log(spark):
    d = _tmp()
    reg = spark.createDataFrame([("r1", 0, 0, "q", 1.0), ("r2", 0, 1, "q", 2.0)],
                                "run string, cv_id int, fold int, target string, w double")
    files.registry_save(reg, d + "/reg")
    assert [r.w for r in files.registry_load(spark, d + "/reg", "r2").collect()] == [2.0]
    log = spark.createDataFrame([("r1", 0, 1, 10, "loss", 0.5, 24)],
                                "run string, fold int, epoch int, step long, name string, value double, n long")
    files.log_metrics(log, d + "/log")
    files.log_metrics(log, d + "/log")
    assert spark.read.parquet(d + "/log").count() == 2


def test_feature_store_computes_again_what_a_run_left_unfinished(spark):
    """A run that dies between two parts, and a part of a partition laid by hand."""
    d = _tmp() + "/store"
    wanted = spark.createDataFrame([(0, "01"), (1, "1"), (2, None)], "block int, name string")

    def rows(missing, fails=False):
        out = missing.select("*", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("i"))
        bad = F.when((F.col("block") == 1) & (F.col("i") > 50), F.raise_error(F.lit("lost"))).otherwise(F.col("i"))
        return out.withColumn("i", bad.cast("int")) if fails else out

    try:
        files.feature_store_get_or_compute(spark, d, wanted, ["block", "name"], lambda m: rows(m, fails=True)).collect()
        raise AssertionError("expected the run to die")
    except Exception as e:  # noqa: BLE001
        assert "lost" in str(e)
    spark.createDataFrame([(7,)] * 3, "i int").write.parquet(d + "/data/commit=half/block=0/name=01")
    calls = []

    def compute(missing):
        calls.append(missing.count())
        return rows(missing)

    out = files.feature_store_get_or_compute(spark, d, wanted, ["block", "name"], compute)
    counts = {(r["block"], r["name"]): r["n"] for r in out.groupBy("block", "name").agg(F.count("*").alias("n")).collect()}
    assert counts == {(0, "01"): 100, (1, "1"): 100, (2, None): 100} and calls == [3]
    again = files.feature_store_get_or_compute(spark, d, wanted.where("block > 0"), ["block", "name"], compute)
    assert again.count() == 200 and calls == [3] and set(again.columns) == {"block", "name", "i"}
    # a key without rows is finished too; nothing wanted is nothing computed
    none = spark.createDataFrame([(9, "x")], "block int, name string")
    for _ in range(2):
        assert files.feature_store_get_or_compute(spark, d, none, ["block", "name"],
                                                  lambda m: compute(m).where("i < 0")).count() == 0
    assert calls == [3, 1]
    assert files.feature_store_get_or_compute(spark, d, none.limit(0), ["block", "name"], rows).count() == 0


def test_feature_store_takes_one_of_two_saves_of_a_key(spark):
    from gradewell.sources import committed

    d = _tmp() + "/store"
    for v in (1, 2):
        rows = spark.createDataFrame([(0, v), (0, v)], "block int, v int")
        committed.save(rows, d, ["block"], spark.createDataFrame([('{"block":0}',)], "keys string"))
    out = files.feature_store_get_or_compute(spark, d, spark.createDataFrame([(0,)], "block int"), ["block"],
                                             lambda m: 1 / 0)
    assert [r["v"] for r in out.collect()] == [2, 2]


def test_registry_keeps_other_cells_and_loads_the_latest(spark):
    d = _tmp() + "/reg"
    schema = "run string, cv_id int, model string, fold int, target string, w double"

    def save(*rows):
        files.registry_save(spark.createDataFrame(list(rows), schema), d)

    save(("r", 0, "m", 0, "q", 1.0))
    save(("r", 0, "m", 1, "q", 2.0), ("other", 0, "m", 1, "q", 9.0))
    save(("r", 0, "m", 0, "t", 3.0), ("r", 0, "m", None, "q", 4.0))
    save(("r", 0, "m", 0, "q", 5.0), ("r", 0, "m", None, "q", 6.0))
    loaded = {(r["fold"], r["target"]): r["w"] for r in files.registry_load(spark, d, "r").collect()}
    assert loaded == {(0, "q"): 5.0, (1, "q"): 2.0, (0, "t"): 3.0, (None, "q"): 6.0}
    # a save without its manifest row is not there
    spark.createDataFrame([("m", 0, "q", 8.0)], "model string, fold int, target string, w double") \
        .write.parquet(d + "/data/commit=cut/run=r")
    assert files.registry_load(spark, d, "r").count() == 4
    # a later save may have more columns
    files.registry_save(spark.createDataFrame([("r", 0, "m", 2, "q", 7.0, "x")], schema + ", note string"), d)
    assert {r["note"] for r in files.registry_load(spark, d, "r").collect()} == {None, "x"}
    try:
        files.registry_load(spark, d + "-none", "r")
        raise AssertionError("expected an error")
    except ValueError as e:
        assert "no model" in str(e)


def test_discover_keys_from_file_names(spark):
    d = _tmp()
    for name in ("deb_gpu0_fold1_best.pth", "deb_gpu1_fold3_best.pth", "notes.txt", "deb_gpu1_fold3.pth"):
        with open(f"{d}/{name}", "wb") as fh:
            fh.write(b"x")
    names = ["model", "gpu", "fold"]
    found = files.discover(spark, d, r"([a-z]+)_gpu(\d+)_fold(\d+)_best", names, glob="*best*.pth")
    keys = sorted((r.model, r.gpu, r.fold) for r in found.collect())
    assert keys == [("deb", "0", "1"), ("deb", "1", "3")]
    assert "content" not in found._jdf.queryExecution().executedPlan().toString()      # nothing is opened
    assert files.unique_match(found, names).count() == 2
    import os

    os.mkdir(f"{d}/more")
    with open(f"{d}/more/deb_gpu0_fold1_best.pth", "wb") as fh:
        fh.write(b"y")
    twice = files.unique_match(files.discover(spark, d, r"([a-z]+)_gpu(\d+)_fold(\d+)_best", names), names)
    try:
        twice.collect()
        raise AssertionError("expected two matches to raise")
    except Exception as e:  # noqa: BLE001
        assert "ambiguous match" in str(e)


# ------------------------------------------------------------------ CSV over many tasks

ODD_TEXTS = [None, "", "plain", 'a "quoted" word', "two\nlines", "\nstarts", "ends\n", "comma, and\r\nDOS end", '"', '""',
             "  blanks kept  ", "\n\n\n", '"\n"', "x" * 5000, "line\n" * 700, "ünïcode ☃\n雪"]


def _csv_rows(n):
    return [(f"id{i}", ODD_TEXTS[i % len(ODD_TEXTS)], *[float(i % 9) / 2] * 6) for i in range(n)]


def test_split_csv_reads_what_one_task_reads(spark):
    d = _tmp()
    df = spark.createDataFrame(_csv_rows(800), files.ESSAY_SCHEMA)
    files.write_csv(df.coalesce(2), d + "/essays")
    one = files.read_csv(spark, d + "/essays", files.ESSAY_SCHEMA)
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("1m", "20k", "3000b"):          # records longer than a split, and splits within quoted fields
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            got = split_csv.read_split_csv(spark, d + "/essays", files.ESSAY_SCHEMA)
            rows = sorted(got.collect(), key=str)
            assert rows == sorted(one.collect(), key=str) and len(rows) == 800
            splits = split_csv._lines(spark, d + "/essays").select("file", "split").distinct().count()
            assert splits >= {"1m": 2, "20k": 16, "3000b": 100}[size]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert sorted(r["full_text"] or "" for r in rows) == sorted((t or "") for _, t, *_ in _csv_rows(800))


def test_split_csv_fails_fast(spark):
    d = _tmp()
    head = "text_id,full_text," + ",".join(REFERENCE_TARGETS) + "\n"
    cases = {"number": 'x,"a\nb",not_a_number,1,1,1,1,1\n', "open": 'x,"a\nb,1,1,1,1,1,1\n'}
    for name, text in cases.items():
        with open(f"{d}/{name}.csv", "w") as fh:
            fh.write(head + text)
        try:
            split_csv.read_split_csv(spark, f"{d}/{name}.csv", files.ESSAY_SCHEMA).collect()
            raise AssertionError("expected a failure")
        except Exception as e:  # noqa: BLE001
            assert "expected a failure" not in str(e)
    for name, text in {"empty": "", "head": head, "last": head + '\n\ny,"no newline\nat the end",1,1,1,1,1,1'}.items():
        with open(f"{d}/{name}.csv", "w") as fh:
            fh.write(text)
        got = split_csv.read_split_csv(spark, f"{d}/{name}.csv", files.ESSAY_SCHEMA).collect()
        assert [r["full_text"] for r in got] == (["no newline\nat the end"] if name == "last" else [])
