"""Fragment merge, lengths, id overlap, unlabelled pool, template, containment, paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewell.config import TEMPLATE_GRADE
from gradewell.functions import text as tx
from gradewell.operators import containment, fragments
from gradewell.operators.rowindex import global_row_index, range_bucket
from gradewell.plans import common as c
from gradewell.plans.registry import query
from gradewell.session import scratch_path
from gradewell.sources import tables

T = c.TARGETS

SQL_MERGED = """
  SELECT conv_id AS id,
         regexp_replace(replace(replace(string_agg(text, ' ' ORDER BY turn), chr(10), ' '),
                                chr(7), ' '), ' +', ' ', 'g') AS merged_text,
         count(*) AS n_fragments
  FROM conversations GROUP BY conv_id"""


def _merged(spark, sf):
    return fragments.merge_fragments(tables.fragments(spark, sf))


@query("merge_fragments", "D1 G1 G2 G3 K1", sql=SQL_MERGED)
def merge_fragments(spark, sf):
    return _merged(spark, sf)


@query("fragment_lengths", "B3 G4", sql="""
SELECT conv_id, turn, role, CAST(length(text) AS INTEGER) AS text_len FROM conversations""")
def fragment_lengths(spark, sf):
    conv = tables.table(spark, sf, "conversations")
    return conv.select("conv_id", "turn", "role", F.length("text").alias("text_len"))


@query("overlap_ratio", "F3 F5 D15 C4", sql="""
SELECT CAST(count(DISTINCT l.doc_id) FILTER (WHERE l.doc_id IN (SELECT conv_id FROM conversations)) AS BIGINT) AS n_common,
       CAST(count(*) AS BIGINT) AS n_labelled,
       round(count(DISTINCT l.doc_id) FILTER (WHERE l.doc_id IN (SELECT conv_id FROM conversations)) / count(*), 6) AS ratio
FROM labels l""")
def overlap_ratio(spark, sf):
    ids = tables.fragments(spark, sf).select("id")
    lab = tables.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    out = fragments.overlap(ids, lab, "id")
    return out.select("n_common", "n_labelled", c.r6("ratio").alias("ratio"))


@query("unlabelled_pool", "C3 B5 F4 J13", sql=f"""
SELECT id AS text_id, merged_text AS full_text FROM ({SQL_MERGED}) m
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = m.id)""")
def unlabelled_pool(spark, sf):
    lab = tables.table(spark, sf, "labels").select(F.col("doc_id").alias("text_id"))
    return fragments.unlabelled_pool(_merged(spark, sf), lab)


@query("pool_template", "B2 B4 A9", sql=f"""
SELECT id AS text_id, {', '.join(f'{TEMPLATE_GRADE} AS {t}' for t in T)} FROM ({SQL_MERGED}) m
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = m.id)""")
def pool_template(spark, sf):
    lab = tables.table(spark, sf, "labels").select(F.col("doc_id").alias("text_id"))
    pool = fragments.unlabelled_pool(_merged(spark, sf), lab)
    return pool.select("text_id").withColumns({t: F.lit(TEMPLATE_GRADE) for t in T})


@query("containment_pairs", "C8", sql="""
SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def containment_pairs(spark, sf):
    docs = tables.table(spark, sf, "documents").select("doc_id", "text")
    items = tables.table(spark, sf, "benchmark").select("item_id", "text")
    return containment.contained_pairs(items, docs, "item_id", "doc_id")


@query("containment_ratio", "C8 D15", sql="""
SELECT 'items_in_documents' AS direction, CAST(count(*) AS BIGINT) AS n_total,
       CAST(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))) AS BIGINT) AS n_found,
       round(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))) / count(*), 6) AS ratio
FROM benchmark b
UNION ALL
SELECT 'documents_in_items', CAST(count(*) AS BIGINT),
       CAST(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(b.text, d.text))) AS BIGINT),
       round(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(b.text, d.text))) / count(*), 6)
FROM documents d""")
def containment_ratio(spark, sf):
    docs = tables.table(spark, sf, "documents").select("doc_id", "text")
    items = tables.table(spark, sf, "benchmark").select("item_id", "text")
    a = containment.containment_share(items, docs, "item_id", "doc_id") \
        .withColumn("direction", F.lit("items_in_documents"))
    b = containment.containment_share(docs, items, "doc_id", "item_id") \
        .withColumn("direction", F.lit("documents_in_items"))
    out = a.unionByName(b)
    return out.select("direction", "n_total", "n_found", c.r6("ratio").alias("ratio"))


SQL_JOINED = """(SELECT string_agg(coalesce(text, ''), ' ' ORDER BY doc_id, text) AS s FROM documents)"""
SQL_JOINED_TURNS = """(SELECT string_agg(coalesce(text, ''), ' ' ORDER BY conv_id, turn, text) AS s FROM conversations)"""


@query("containment_joined", "C8 D15", sql=f"""
SELECT 'items_in_documents' AS direction, CAST(count(*) AS BIGINT) AS n_total,
       CAST(count(*) FILTER (WHERE b.text <> '' AND contains(s, b.text)) AS BIGINT) AS n_found,
       round(count(*) FILTER (WHERE b.text <> '' AND contains(s, b.text)) / count(*), 6) AS ratio
FROM benchmark b, {SQL_JOINED}
UNION ALL
SELECT 'tails_in_documents', CAST(count(*) AS BIGINT),
       CAST(count(*) FILTER (WHERE t <> '' AND contains(s, t)) AS BIGINT),
       round(count(*) FILTER (WHERE t <> '' AND contains(s, t)) / count(*), 6)
FROM (SELECT right(coalesce(text, ''), 30) || ' ' ||
             left(coalesce(lead(text) OVER (ORDER BY doc_id, text), ''), 30) AS t FROM documents), {SQL_JOINED}
UNION ALL
SELECT 'items_in_turns', CAST(count(*) AS BIGINT),
       CAST(count(*) FILTER (WHERE b.text <> '' AND contains(s, b.text)) AS BIGINT),
       round(count(*) FILTER (WHERE b.text <> '' AND contains(s, b.text)) / count(*), 6)
FROM benchmark b, {SQL_JOINED_TURNS}""")
def containment_joined(spark, sf):
    """Containment in the one string that all texts make, in id order: what crosses the end
    of a text counts too. The tails, each text's end and the next one's start, all do."""
    docs = tables.table(spark, sf, "documents").select("doc_id", "text")
    items = tables.table(spark, sf, "benchmark").select("item_id", "text")
    turns = tables.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    ends = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    numbered = global_row_index(range_bucket(ends, "doc_id", "b"), ["doc_id", "text"], bucket=F.col("b"), name="i")
    path = scratch_path(spark, "text-ends")           # 60 characters of each text, read twice
    numbered.select("i", F.expr("right(text, 30)").alias("tail"), F.substring("text", 1, 30).alias("head")).write.parquet(path)
    numbered = spark.read.parquet(path)
    following = numbered.select((F.col("i") - 1).alias("i"), F.col("head").alias("next"))
    tails = numbered.join(following, "i", "left").select(
        F.lit("tails_in_documents").alias("direction"),
        F.concat("tail", F.lit(" "), F.coalesce("next", F.lit(""))).alias("text"))
    # items and tails are looked up in one pass over the documents' string
    either = items.select(F.lit("items_in_documents").alias("direction"), "text").unionByName(tails)
    shares = containment.joined_share(either, docs, "direction", ["doc_id", "text"], by=["direction"]).unionByName(
        containment.joined_share(items, turns, "item_id", ["conv_id", "turn", "text"])
        .withColumn("direction", F.lit("items_in_turns")), allowMissingColumns=True)
    names = spark.createDataFrame([(d,) for d in ("items_in_documents", "tails_in_documents", "items_in_turns")], "direction string")
    none = F.lit(0).cast("long")                      # a side without patterns has a row too
    return names.join(F.broadcast(shares), "direction", "left").select(
        "direction", F.coalesce("n_total", none).alias("n_total"), F.coalesce("n_found", none).alias("n_found"),
        c.r6("ratio").alias("ratio"))


@query("url_parts", "A8 G5 G6", sql="""
SELECT page_id, string_split(url, '/')[-1] AS basename,
       regexp_replace(string_split(url, '/')[-1], '\\.[^.]*$', '') AS stem,
       replace(regexp_replace(string_split(url, '/')[-1], '\\.[^.]*$', ''), '/', '-') AS artefact
FROM pages""")
def url_parts(spark, sf):
    pages = tables.table(spark, sf, "pages")
    u = F.col("url")
    return pages.select("page_id", tx.basename(u).alias("basename"), tx.stem(u).alias("stem"),
                        tx.artefact_name(u).alias("artefact"))


@query("essay_sources", "B1 F2 B4", sql="""
SELECT d.doc_id AS text_id,
       CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) THEN 'train' ELSE 'test' END AS src,
       CAST(length(coalesce(d.text, '')) AS INTEGER) AS n_chars
FROM documents d""")
def essay_sources(spark, sf):
    """Labelled and unlabelled essays stacked with a constant lineage tag."""
    n = F.length(F.coalesce(F.col("text"), F.lit("")))
    docs = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), n.alias("n_chars"))
    ids = tables.table(spark, sf, "labels").select(F.col("doc_id").alias("text_id"))
    train = docs.join(ids, "text_id", "left_semi").withColumn("src", F.lit("train"))
    test = docs.join(ids, "text_id", "left_anti").withColumn("src", F.lit("test"))
    return train.unionByName(test).select("text_id", "src", "n_chars")
