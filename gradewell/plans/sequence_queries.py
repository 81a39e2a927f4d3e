"""Token sequences over the documents table (regex tokens, distributed vocabulary)."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from gradewell.operators import sequences as sq
from gradewell.plans.common import r6
from gradewell.plans.registry import query
from gradewell.sources import tables

MAX_LEN = 512       # one of the reference's per-model maximum lengths
BATCH = 16          # the reference's inference batch size for one model family
P = sq.TOKEN_PATTERN

SQL_TOKS = f"SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{P}') AS toks FROM documents"
SQL_VOCAB = f"""
  SELECT token, cnt, row_number() OVER (ORDER BY cnt DESC, token) + {sq.N_SPECIAL - 1} AS token_id
  FROM (SELECT token, count(*) AS cnt FROM (SELECT unnest(toks) AS token FROM ({SQL_TOKS})) GROUP BY token)"""
SQL_LENS = f"""
  SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens, CAST(len(toks) + 2 AS INTEGER) AS token_length
  FROM ({SQL_TOKS})"""


def _docs(spark, sf):
    return tables.table(spark, sf, "documents").select("doc_id", "text")


def _lens(spark, sf):
    """Token lengths (a few numbers per document), persisted: the length
    batches and padding reports read them several times and each read would
    otherwise re-run the tokeniser over every text."""
    return sq.lengths(_docs(spark, sf)).persist(StorageLevel.MEMORY_AND_DISK)


@query("token_vocab", "H1", sql=SQL_VOCAB)
def token_vocab(spark, sf):
    return sq.build_vocab(sq.token_rows(_docs(spark, sf)))


@query("token_length", "H2 K2", sql=SQL_LENS)
def token_length(spark, sf):
    return _lens(spark, sf)


@query("truncate_pad", "H1 H3 H4 H5 K3", sql=f"""
WITH t AS ({SQL_TOKS}), v AS ({SQL_VOCAB}),
     r AS (SELECT doc_id, generate_subscripts(toks, 1) - 1 AS tpos, unnest(toks) AS token FROM t),
     k AS (SELECT doc_id, least(len(toks), {MAX_LEN - 2}) AS kk FROM t)
SELECT r.doc_id, CAST(r.tpos + 1 AS INTEGER) AS pos, CAST(v.token_id AS INTEGER) AS input_id, 1 AS attention_mask
FROM r JOIN v ON r.token = v.token WHERE r.tpos < {MAX_LEN - 2}
UNION ALL SELECT doc_id, 0, {sq.CLS}, 1 FROM k
UNION ALL SELECT doc_id, CAST(kk + 1 AS INTEGER), {sq.SEP}, 1 FROM k
UNION ALL SELECT doc_id, CAST(unnest(range(kk + 2, {MAX_LEN})) AS INTEGER), {sq.PAD}, 0 FROM k""")
def truncate_pad(spark, sf):
    docs = _docs(spark, sf)
    encoded = sq.encode_ids(docs, sq.build_vocab(sq.token_rows(docs)), MAX_LEN)
    return sq.truncate_pad_long(encoded, MAX_LEN)


@query("attention_mask", "H4", sql=f"""
SELECT doc_id, CAST(least(n_tokens, {MAX_LEN - 2}) + 2 AS INTEGER) AS n_real,
       CAST({MAX_LEN} - least(n_tokens, {MAX_LEN - 2}) - 2 AS INTEGER) AS n_pad FROM ({SQL_LENS})""")
def attention_mask(spark, sf):
    n_real = F.least(F.col("n_tokens"), F.lit(MAX_LEN - 2)) + F.lit(2)
    return _lens(spark, sf).select("doc_id", n_real.alias("n_real"),
                                   (F.lit(MAX_LEN) - n_real).alias("n_pad"))


SQL_BATCHED = f"""
  SELECT doc_id, token_length, rank, (rank - 1) // {BATCH} AS batch_id
  FROM (SELECT *, row_number() OVER (ORDER BY token_length, doc_id) AS rank FROM ({SQL_LENS}))"""


@query("batch_by_length", "E1 E2", sql=SQL_BATCHED)
def batch_by_length(spark, sf):
    b = sq.length_batches(_lens(spark, sf), BATCH)
    return b.select("doc_id", "token_length", "rank", "batch_id")


@query("pad_to_longest", "H6 H7 K4", sql=f"""
WITH b AS ({SQL_BATCHED}), v AS ({SQL_VOCAB}),
     r AS (SELECT doc_id, generate_subscripts(toks, 1) - 1 AS tpos, unnest(toks) AS token FROM ({SQL_TOKS})),
     i AS (SELECT r.doc_id, string_agg(CAST(v.token_id AS VARCHAR), ' ' ORDER BY r.tpos) AS ids
           FROM r JOIN v ON r.token = v.token WHERE r.tpos < {MAX_LEN - 2} GROUP BY r.doc_id),
     p AS (SELECT doc_id, batch_id, least(token_length, {MAX_LEN}) AS length,
                  max(least(token_length, {MAX_LEN})) OVER (PARTITION BY batch_id) AS padded_length FROM b)
SELECT p.doc_id, batch_id, length, padded_length,
       '{sq.CLS}' || coalesce(' ' || ids, '') || ' {sq.SEP}' || repeat(' {sq.PAD}', padded_length - length) AS input_ids,
       trim(repeat('1 ', length) || repeat('0 ', padded_length - length)) AS attention_mask
FROM p LEFT JOIN i ON p.doc_id = i.doc_id""")
def pad_to_longest(spark, sf):
    """Arrays of every batch's own width; shown as text, ids parted by spaces."""
    docs = _docs(spark, sf)
    encoded = sq.encode_ids(docs, sq.build_vocab(sq.token_rows(docs)), MAX_LEN)
    out = sq.padded_batches(encoded, BATCH, MAX_LEN)
    return out.withColumns({x: F.array_join(F.col(x).cast("array<string>"), " ") for x in ("input_ids", "attention_mask")})


@query("padding_waste", "H8", sql=f"""
WITH l AS (SELECT doc_id, least(token_length, {MAX_LEN}) AS len FROM ({SQL_LENS})),
     s AS (SELECT len, (row_number() OVER (ORDER BY len, doc_id) - 1) // {BATCH} AS b FROM l),
     u AS (SELECT len, (row_number() OVER (ORDER BY doc_id) - 1) // {BATCH} AS b FROM l),
     r AS (SELECT 'fixed' AS strategy, sum(len) AS real_cells, CAST(count(*) * {MAX_LEN} AS HUGEINT) AS padded_cells FROM l
           UNION ALL SELECT 'longest_sorted', sum(len), sum(m) FROM (SELECT b, sum(len) AS len, max(len) * count(*) AS m FROM s GROUP BY b)
           UNION ALL SELECT 'longest_unsorted', sum(len), sum(m) FROM (SELECT b, sum(len) AS len, max(len) * count(*) AS m FROM u GROUP BY b))
SELECT strategy, CAST(real_cells AS BIGINT) AS real_cells, CAST(padded_cells AS BIGINT) AS padded_cells,
       round((padded_cells - real_cells) / real_cells, 6) AS waste_ratio FROM r""")
def padding_waste(spark, sf):
    lens = _lens(spark, sf)
    length = F.least(F.col("token_length"), F.lit(MAX_LEN))

    def per_batch(batched, name):
        g = batched.groupBy("batch_id").agg(F.sum(length).alias("_real"),
                                           (F.max(length) * F.count(F.lit(1))).alias("_pad"))
        return g.agg(F.sum("_real").cast("long").alias("real_cells"),
                     F.sum("_pad").cast("long").alias("padded_cells")) \
            .withColumn("strategy", F.lit(name))

    fixed = lens.agg(F.sum(length).cast("long").alias("real_cells"),
                     (F.count(F.lit(1)) * F.lit(MAX_LEN)).cast("long").alias("padded_cells")) \
        .withColumn("strategy", F.lit("fixed"))
    out = fixed.unionByName(per_batch(sq.length_batches(lens, BATCH), "longest_sorted")) \
        .unionByName(per_batch(sq.id_batches(lens, BATCH), "longest_unsorted"))
    ratio = (F.col("padded_cells") - F.col("real_cells")) / F.col("real_cells")
    return out.select("strategy", "real_cells", "padded_cells", r6(ratio).alias("waste_ratio"))


@query("corpus_max_len", "D14", sql=f"""
SELECT CAST(max(n_tokens) + 2 AS INTEGER) AS max_len FROM ({SQL_LENS})""")
def corpus_max_len(spark, sf):
    return _lens(spark, sf).agg((F.max("n_tokens") + F.lit(2)).cast("int").alias("max_len"))
