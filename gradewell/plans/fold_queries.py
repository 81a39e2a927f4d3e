"""Fold assignment, fold sizes, training cells, sampling and shuffles."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewell.config import DEFAULT_SEED, N_FOLDS, SEEDS
from gradewell.operators import folds as fo
from gradewell.operators import sampling
from gradewell.plans import common as c
from gradewell.plans.registry import query
from gradewell.sources import tables


def _labels(spark, sf):
    return tables.table(spark, sf, "labels").select(
        F.col("doc_id").alias("text_id"), "quality", "toxic")


@query("kfold_balanced", "J1 J16 B13", sql=f"""
SELECT doc_id AS text_id, {c.sql_fold_expr('doc_id', strata=())} AS fold FROM labels""")
def kfold_balanced(spark, sf):
    return fo.assign_folds(_labels(spark, sf), "text_id", N_FOLDS, DEFAULT_SEED) \
        .select("text_id", "fold")


@query("kfold_stratified", "J1 J16 B13", sql=f"""
SELECT doc_id AS text_id, {c.sql_fold_expr('doc_id')} AS fold FROM labels""")
def kfold_stratified(spark, sf):
    return fo.assign_folds(_labels(spark, sf), "text_id", N_FOLDS, DEFAULT_SEED,
                           strata=c.STRATA).select("text_id", "fold")


@query("kfold_repeated", "J1 J2 J16", sql=" UNION ALL ".join(
    f"SELECT {i} AS cv_id, doc_id AS text_id, {c.sql_fold_expr('doc_id', seed=s)} AS fold FROM labels"
    for i, s in enumerate(SEEDS)))
def kfold_repeated(spark, sf):
    return fo.repeated_folds(_labels(spark, sf), "text_id", N_FOLDS, SEEDS, strata=c.STRATA)


@query("kfold_iterative", "J1")
def kfold_iterative(spark, sf):
    """Iterative multilabel stratification; no SQL twin (greedy on tuple counts)."""
    return fo.iterative_folds(_labels(spark, sf), "text_id", list(c.STRATA), N_FOLDS, DEFAULT_SEED)


@query("fold_sizes", "D2", sql=f"""
SELECT fold, count(*) AS n FROM (SELECT {c.sql_fold_expr('doc_id')} AS fold FROM labels)
GROUP BY fold""")
def fold_sizes(spark, sf):
    return fo.fold_sizes(kfold_stratified(spark, sf))


@query("cv_roles", "B7 C10", sql=f"""
SELECT s.split, f.text_id, CASE WHEN f.fold = s.split THEN 'valid' ELSE 'train' END AS role
FROM (SELECT doc_id AS text_id, {c.sql_fold_expr('doc_id')} AS fold FROM labels) f,
     (SELECT CAST(range AS INTEGER) AS split FROM range({N_FOLDS})) s""")
def cv_roles(spark, sf):
    return fo.cv_roles(kfold_stratified(spark, sf), N_FOLDS).select("split", "text_id", "role")


@query("shuffle_epoch", "E3 J16", sql="""
SELECT e.epoch, d.doc_id AS text_id,
       row_number() OVER (PARTITION BY e.epoch ORDER BY md5('2022:' || CAST(e.epoch AS VARCHAR) || ':' || CAST(d.doc_id AS VARCHAR)), d.doc_id) AS pos
FROM documents d, (SELECT CAST(range AS INTEGER) AS epoch FROM range(2)) e""")
def shuffle_epoch(spark, sf):
    docs = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"))
    return sampling.seeded_shuffle(docs, "text_id", DEFAULT_SEED, epochs=2)


@query("sample_n", "B11 E10", sql="""
SELECT doc_id FROM documents ORDER BY md5('2022:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50""")
def sample_n(spark, sf):
    docs = tables.table(spark, sf, "documents").select("doc_id")
    return sampling.sample_n(docs, "doc_id", 50, DEFAULT_SEED)


@query("point_lookup", "B8", sql="""
SELECT doc_id, text FROM documents WHERE doc_id = 42""")
def point_lookup(spark, sf):
    return tables.table(spark, sf, "documents").where(F.col("doc_id") == 42).select("doc_id", "text")


@query("profile", "B12", sql="""
SELECT count(*) AS n_rows, count(*) - count(text) AS n_null_text,
       count(DISTINCT text) AS n_distinct_text, count(DISTINCT lang) AS n_distinct_lang,
       min(n_chars) AS min_chars, max(n_chars) AS max_chars, round(avg(n_chars), 6) AS avg_chars
FROM documents""")
def profile(spark, sf):
    docs = tables.table(spark, sf, "documents")
    return sampling.profile(docs)


GRADES = ("label", "third", "sign")
SQL_GRADES = """SELECT vec_id, label, label // 3 AS third, CAST(embedding[1] > 0 AS INTEGER) AS sign FROM embeddings"""


@query("kfold_iterative_grades", "J1", sql=" UNION ALL ".join(f"""
SELECT '{g}' AS target, CAST({g} AS INTEGER) AS grade, CAST(f AS INTEGER) AS fold, count(*) AS n_rows, true AS within_one
FROM ({SQL_GRADES}), (SELECT unnest(range({N_FOLDS})) AS f) GROUP BY ALL""" for g in GRADES))
def kfold_iterative_grades(spark, sf):
    """Iterative folds over labels of ten, four and two grades: whether every fold holds
    each grade's share, to within one row."""
    emb = tables.table(spark, sf, "embeddings")
    lab = emb.select("vec_id", "label", F.expr("label div 3").cast("int").alias("third"),
                     (F.col("embedding")[0] > 0).cast("int").alias("sign"))
    folds = fo.iterative_folds(lab, "vec_id", list(GRADES), N_FOLDS, DEFAULT_SEED)
    long = lab.join(folds, "vec_id").select("fold", F.inline(F.array(*[
        F.struct(F.lit(g).alias("target"), F.col(g).alias("grade")) for g in GRADES])))
    each = long.groupBy("target", "grade").agg(F.count("*").alias("n_rows"), *[
        F.count_if(F.col("fold") == f).alias(f"n{f}") for f in range(N_FOLDS)])
    return each.select("target", "grade", "n_rows", F.inline(F.array(*[
        F.struct(F.lit(f).alias("fold"), (F.abs(F.col(f"n{f}") - F.col("n_rows") / N_FOLDS) <= 1).alias("within_one"))
        for f in range(N_FOLDS)])))
