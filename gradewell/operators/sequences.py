"""Text -> token-id sequences as Spark jobs (tokenise, vocabulary, truncate,
pad, mask, length batches, padding reports).

Tokens are regex word/punctuation units. The vocabulary is built by one
distributed count; ids are ranks by (count desc, token) numbered with the
bucketed row index. Special ids: 0 = PAD, 1 = CLS, 2 = SEP, 3 = UNK.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.operators.parallel import spread
from gradewell.operators.rowindex import global_row_index, ordered_row_index, range_bucket
from gradewell.session import scratch_path

# FIXED VALUES: special token ids and the token pattern (words or one symbol)
PAD, CLS, SEP, UNK = 0, 1, 2, 3
N_SPECIAL = 4
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"
VOCAB_BROADCAST_MAX = 2_000_000   # entries (~100 MB); of larger vocabularies a task holds what its documents need


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), 0)


def token_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, tpos, token)``: one row per token occurrence, 0-based position."""
    return spread(docs.select(id_col, text_col)).select(
        id_col, F.posexplode(tokens(F.coalesce(F.col(text_col), F.lit("")))).alias("tpos", "token"))


def build_vocab(tok_rows: DataFrame) -> DataFrame:
    """``(token, cnt, token_id)``; ids from N_SPECIAL by (count desc, token).

    Numbered per count value (the stratum), split by the first two
    characters of the token (order-compatible with the token order), then
    offset by the prefix sum over distinct counts; the huge low-count tail is
    spread over many windows. The
    distinct-token counts are persisted (they are read twice by the row index
    and are far smaller than the token occurrences they summarise).
    """
    counts = tok_rows.groupBy("token").agg(F.count(F.lit(1)).alias("cnt")) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    ranked = ordered_row_index(counts, "cnt", [F.col("token").asc()],
                               bucket=F.substring("token", 1, 2), descending=True, name="_rank")
    return ranked.select("token", "cnt", (F.col("_rank") + F.lit(N_SPECIAL - 1)).alias("token_id"))


def encode_ids(docs: DataFrame, vocab: DataFrame, max_len: int, id_col: str = "doc_id", text_col: str = "text",
               most: int = VOCAB_BROADCAST_MAX, docs_per_chunk: int = 4096) -> DataFrame:
    """``(id, n_tokens, ids)``: how many tokens a document has, and the ids of its first
    ``max_len - 2``; a token that the vocabulary lacks is ``UNK``.

    A document is encoded where it is read: tokens are looked up in tasks that hold the
    vocabulary, so no token is a row. The vocabulary is persisted and counted first (the
    counting pass is the pass that builds it), and sent out only if it has at most ``most``
    entries. A larger one is joined with the distinct tokens of each chunk of documents,
    and the chunks are encoded beside their own part of it; no other token is a row.
    """
    v = vocab.select("token", "token_id").persist(StorageLevel.MEMORY_AND_DISK)
    found = tokens(F.coalesce(F.col(text_col), F.lit("")))
    rows = spread(docs.select(id_col, text_col)).select(
        F.col(id_col), F.size(found).alias("n_tokens"), F.slice(found, 1, max_len - 2).alias("_toks"))
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_tokens int, ids array<int>"
    if v.count() <= most:
        table = v.toArrow()
        spark = docs.sparkSession
        held = spark.sparkContext.broadcast(dict(zip(table["token"].to_pylist(), table["token_id"].to_pylist())))

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = held.value
            for batch in batches:
                ids = [[known.get(t, UNK) for t in toks] for toks in batch.column("_toks").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col), batch.column("n_tokens"), pa.array(ids, pa.list_(pa.int32()))],
                    [id_col, "n_tokens", "ids"])

        return rows.mapInArrow(look_up, schema)
    # a task cuts its documents into chunks as they come and lists each chunk's words once;
    # the documents are stored with their chunk, so that both sides have the same ones
    spark = docs.sparkSession

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33
        for i, part in enumerate(b.slice(at, docs_per_chunk) for b in batches for at in range(0, b.num_rows, docs_per_chunk)):
            toks = part.column("_toks")
            words = pc.unique(toks.flatten())
            sizes = pc.list_value_length(toks).to_numpy(zero_copy_only=False)
            places = pc.index_in(toks.flatten(), words).to_numpy(zero_copy_only=False).astype(np.int32)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            listed = pa.ListArray.from_arrays(pa.array(np.array([0] + [len(words)] * part.num_rows, np.int32)), words)
            yield pa.RecordBatch.from_arrays(
                [part.column(id_col), part.column("n_tokens"), pa.ListArray.from_arrays(ends, pa.array(places)),
                 pa.array(np.full(part.num_rows, first + i)), listed], [id_col, "n_tokens", "_at", "_chunk", "_words"])

    path = scratch_path(spark, "token-chunks")
    rows.mapInArrow(chunked, f"{id_col} {kind}, n_tokens int, _at array<int>, _chunk long, _words array<string>").write.parquet(path)
    kept = spark.read.parquet(path)
    # a chunk's words stand in its first row, each with its place
    own = (kept.where(F.size("_words") > 0).select("_chunk", F.posexplode("_words").alias("_place", "token"))
           .join(v, "token", "left").select(F.col("_chunk").alias("_part"), "_place", F.coalesce("token_id", F.lit(UNK)).cast("int").alias("id")))

    def beside(docs_: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        known = np.full(len(words), UNK, np.int32)
        known[words["_place"].to_numpy(np.int64)] = words["id"].to_numpy()
        return docs_[[id_col, "n_tokens"]].assign(ids=[known[at] for at in docs_["_at"]])

    return kept.drop("_words").groupBy("_chunk").cogroup(own.groupBy("_part")).applyInPandas(beside, schema)


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, token_length)`` with token_length counting CLS and SEP (H2)."""
    n = F.size(tokens(F.coalesce(F.col(text_col), F.lit(""))))
    return spread(docs.select(id_col, text_col)).select(
        id_col, n.alias("n_tokens"), (n + F.lit(2)).alias("token_length"))


def truncate_pad_long(encoded: DataFrame, max_len: int, id_col: str = "doc_id") -> DataFrame:
    """Long fixed-length sequences ``(id, pos, input_id, attention_mask)`` (H3 H4 H5), made
    of each document's arrays without a shuffle."""
    arrays = truncate_pad_arrays(encoded, max_len)
    cells = F.arrays_zip(F.col("input_ids").alias("input_id"), F.col("attention_mask").alias("attention_mask"))
    return arrays.select(id_col, F.posexplode(cells).alias("pos", "_c")).select(
        id_col, "pos", F.col("_c.input_id").alias("input_id"), F.col("_c.attention_mask").alias("attention_mask"))


def truncate_pad_arrays(id_arrays: DataFrame, max_len: int, seq_col: str = "ids") -> DataFrame:
    """Array form: ``input_ids`` and ``attention_mask`` of exactly ``max_len``."""
    body = F.slice(F.col(seq_col), 1, max_len - 2)
    seq = F.concat(F.array(F.lit(CLS)), body, F.array(F.lit(SEP)))
    n = F.size(seq)
    pad_n = F.greatest(F.lit(max_len) - n, F.lit(0))
    return id_arrays.withColumn("input_ids", F.concat(seq, F.array_repeat(F.lit(PAD), pad_n))) \
        .withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), n),
                                               F.array_repeat(F.lit(0), pad_n)))


def length_batches(lens: DataFrame, batch_size: int, order_col: str = "token_length",
                   id_col: str = "doc_id", name: str = "batch_id") -> DataFrame:
    """Sort by ``order_col`` then id, number rows, batch = (rank-1) div size.

    Numbered per length value (split into id ranges for a length shared by
    many documents), then offset by the prefix sum over distinct lengths.
    """
    ranked = ordered_row_index(range_bucket(lens, id_col, "_range"), order_col, [id_col],
                               bucket=F.col("_range"), name="rank").drop("_range")
    return ranked.withColumn(name, F.floor((F.col("rank") - 1) / F.lit(batch_size)).cast("long"))


def id_batches(lens: DataFrame, batch_size: int, id_col: str = "doc_id",
               name: str = "batch_id") -> DataFrame:
    """Unsorted batches in id order (the padding-waste baseline)."""
    ranked = global_row_index(range_bucket(lens, id_col, "_range"), [id_col], bucket=F.col("_range"), name="_r")
    return ranked.withColumn(name, F.floor((F.col("_r") - 1) / F.lit(batch_size)).cast("long")) \
        .drop("_r", "_range")


def padded_batches(encoded: DataFrame, batch_size: int, max_len: int, id_col: str = "doc_id") -> DataFrame:
    """``pad_to_longest`` of ``length_batches`` over ``encode_ids`` rows, whose ids stay where
    they are while the rows are sorted: these are stored once with a number, the batches
    are made of numbers and lengths alone, and the ids take one shuffle to their widths."""
    path = scratch_path(encoded.sparkSession, "encoded")
    encoded.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    kept = encoded.sparkSession.read.parquet(path)
    lens = kept.select("_row", id_col, (F.col("n_tokens") + F.lit(2)).alias("token_length"))
    batched = length_batches(lens, batch_size, id_col=id_col).select("_row", "batch_id", "token_length")
    return _padded(kept.join(pad_to_longest(batched, max_len, "_row"), "_row"), id_col)


def pad_to_longest(batched: DataFrame, max_len: int, id_col: str = "doc_id") -> DataFrame:
    """Per batch: every sequence padded to the longest truncated length (H6 H7 K4).

    With an ``ids`` column (see ``encode_ids``) also ``input_ids`` and
    ``attention_mask``, both of ``padded_length``.
    """
    length = F.least(F.col("token_length"), F.lit(max_len))
    per_batch = batched.groupBy("batch_id").agg(F.max(length).alias("padded_length"))
    out = batched.join(per_batch, "batch_id").withColumn("length", length)
    columns = [id_col, "batch_id", "length", "padded_length"]
    if "ids" not in batched.columns:
        return out.select(*columns)
    return _padded(out, id_col)


def _padded(rows: DataFrame, id_col: str) -> DataFrame:
    pad = F.col("padded_length") - F.col("length")
    return rows.select(
        id_col, "batch_id", "length", "padded_length",
        F.concat(F.array(F.lit(CLS)), "ids", F.array(F.lit(SEP)), F.array_repeat(F.lit(PAD), pad)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.col("length")), F.array_repeat(F.lit(0), pad)).alias("attention_mask"))
