"""Verbatim containment join: which patterns occur inside which texts.

A quadratic ``contains`` over all pairs does not scale. Instead:

1. Every text is reduced to its set of *minimizers* (Roberts et al., 2004):
   hash every q-character gram, and in every window of ``w`` consecutive
   grams keep the smallest hash. A pattern of length >= w+q-1 that occurs in
   a text shares every window with it, so every minimizer of the pattern is
   a minimizer of the text.
2. Each pattern is anchored on its minimizer that occurs in the fewest texts
   (document frequency from one aggregation), so candidate pairs grow with
   the true matches, not with popular grams.
3. Candidates are verified exactly, where the text lies.

Grams have 8 characters, and 32 for patterns that have a window of such: short
grams recur all over a language, so their texts would grow with the corpus.
Patterns shorter than w+q-1 characters have no full window; their keys are all
their q-character grams (the whole pattern below q characters), and the texts'
grams of the same lengths join the minimizers. Only keys that some
pattern has are kept of the texts, so what is stored grows with the matches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.operators.parallel import spread
from gradewell.operators.rowindex import bucketed_running, range_bucket
from gradewell.session import scratch_path

Q = 8            # characters per gram
W = 16           # grams per window
MIN_LEN = W + Q - 1
WIDE_Q = 32      # characters per gram of patterns that have a window of such
WIDE_LEN = W + WIDE_Q - 1

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(text: str, size: int = Q) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    n = cp.size - size + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            h = h * _BASE + cp[j:j + n]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def minimizers(text: str, size: int = Q) -> np.ndarray:
    """Distinct minimizer values of ``text`` as signed 64-bit ints."""
    h = _gram_hashes(text, size)
    if h.size < W:
        return np.empty(0, dtype=np.int64)
    mins = sliding_window_view(h, W).min(axis=1)
    return np.unique(mins).view(np.int64)


def _key_rows(id_col: str, text_col: str, keys):
    """Batches of (text hash, text) -> one row per distinct key of each text."""
    def fn(batches):
        for pdf in batches:
            for i, t in zip(pdf[id_col].to_numpy(), pdf[text_col].to_numpy()):
                found = np.unique(keys(t))
                if len(found):
                    yield pd.DataFrame({id_col: np.full(len(found), i, dtype=np.int64), "h": found})
    return fn


def _key_map(keys: DataFrame) -> np.ndarray:
    """Which residues the keys have, as a map of 2**16 to 2**26 bits (8 MB at most): tasks
    leave out most keys that no pattern has before an exact join does."""
    bits = min(26, max(16, (16 * keys.count()).bit_length()))
    slot = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    words = (keys.select(F.shiftright(slot, 5).cast("int").alias("word"), F.expr("shiftleft(1L, int(h & 31))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow())
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[words["word"].to_numpy()] = words["bit"].to_numpy().astype(np.uint32)
    return out


def _in_map(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    slot = keys.view(np.uint64) & np.uint64(len(words) * 32 - 1)
    return (words[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0


def _kind(length):
    """What a pattern's keys are: minimizers of wide grams, which few texts share by chance,
    minimizers (0), or for the shortest all grams of so many characters."""
    return F.when(length >= WIDE_LEN, WIDE_Q).when(length >= MIN_LEN, 0).otherwise(F.least(length, F.lit(Q)))


def _keys(text: str, kind: int) -> np.ndarray:
    if kind in (0, WIDE_Q):
        return minimizers(text, kind or Q)
    return _gram_hashes(text, kind).view(np.int64)


def _candidates(pats: DataFrame, docs: DataFrame) -> DataFrame:
    """``(_tk, _pk)``: hashes of texts that have the pattern's rarest key."""
    def pattern_keys(t):
        n = len(t)
        return _keys(t, WIDE_Q if n >= WIDE_LEN else 0 if n >= MIN_LEN else min(n, Q))

    pat_rows = _stored(pats.select("_pk", "_p").mapInPandas(
        _key_rows("_pk", "_p", pattern_keys), "_pk long, h long").distinct(), "pattern-keys")
    # the kinds that the texts need: at most Q + 2
    kinds = sorted(r[0] for r in pats.select(_kind(F.length("_p"))).distinct().collect())
    wanted = pat_rows.select("h").distinct()
    known = _key_map(wanted)

    def text_keys(t):
        found = (_keys(t, kind) for kind in kinds)
        return np.concatenate([np.zeros(0, np.int64), *(k[_in_map(k, known)] for k in found)])

    # read twice (frequencies, then candidates): stored so that the texts are hashed
    # once; only keys that a pattern has are stored
    text_rows = _stored(docs.select("_tk", "_t").mapInPandas(
        _key_rows("_tk", "_t", text_keys), "_tk long, h long").join(wanted, "h", "left_semi").distinct(), "text-keys")
    dfreq = text_rows.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    ranked = pat_rows.join(dfreq, "h", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    anchors = ranked.groupBy("_pk").agg(
        F.min_by("h", F.struct("df", "h")).alias("h"), F.min("df").alias("_df")) \
        .where(F.col("_df") > 0).select("_pk", "h")
    return text_rows.join(anchors, "h", "inner").select("_tk", "_pk")


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A table of the shared folder: what made it need not be kept or run again."""
    path = scratch_path(df.sparkSession, f"containment-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hits(patterns: DataFrame, texts: DataFrame, text_col: str) -> DataFrame:
    """Rows of patterns beside rows of texts that hold them, as ``_p`` and ``_t`` with
    their other columns. Rows are paired by text, so a NULL id is a row like any
    other; two texts of one hash only make a candidate more. A pattern is never longer
    than a text that holds it, so candidates take the patterns to the texts: each text
    travels once, however many patterns it may hold."""
    # a pattern longer than every text cannot occur: exact pruning before hashing
    longest = texts.agg(F.max(F.length(text_col))).scalar()
    pats = spread(patterns.withColumnRenamed(text_col, "_p").where(
        F.col("_p").isNotNull() & (F.length("_p") > 0) & (F.length("_p") <= longest)))
    pats = pats.withColumn("_pk", F.xxhash64("_p"))
    docs = texts.withColumnRenamed(text_col, "_t").where(F.col("_t").isNotNull()).withColumn("_tk", F.xxhash64("_t"))
    asked = _candidates(pats, docs).join(pats, "_pk").withColumnRenamed("_tk", "_ck")
    return asked.join(docs, (F.col("_ck") == F.col("_tk")) & F.contains(F.col("_t"), F.col("_p")))


def contained_pairs(patterns: DataFrame, texts: DataFrame, pat_id: str, text_id: str,
                    text_col: str = "text") -> DataFrame:
    """``(text_id, pat_id)`` for every pattern occurring verbatim in a text.

    ``patterns``: (pat_id, text); ``texts``: (text_id, text). Empty and NULL patterns are
    not matched; rows with a NULL id are matched as others are.
    """
    hits = _hits(patterns.select(F.col(pat_id).alias("_pid"), text_col),
                 spread(texts.select(F.col(text_id).alias("_tid"), text_col)), text_col)
    return hits.select(F.col("_tid").alias(text_id), F.col("_pid").alias(pat_id))


def joined_blocks(texts: DataFrame, order: Sequence[str], text_col: str, overlap: int, sep: str = " ",
                  size: int = 1 << 13) -> DataFrame:
    """``(block, text)``: the string that all texts make when joined by ``sep`` in an order,
    cut into blocks of at least ``size`` characters, each with the ``overlap`` characters
    that follow it.

    Texts get their places by a running sum of lengths over ranges of the order, and are
    cut at the blocks' edges where they lie, so no task holds more than a block and its
    overlap. Any part of the string of ``overlap + 1`` characters or fewer lies in a block.
    A NULL text is empty; ``order`` must tell rows apart.
    """
    size = max(size, overlap)
    rows = texts.select(*order, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    rows = range_bucket(rows, order[0], "_b").withColumn("_n", (F.length("_t") + F.lit(len(sep))).cast("long"))
    placed = bucketed_running(rows, [], list(order), "_b", {"_end": ("sum", "_n")})
    # the separator goes before a text; the first one's is cut off with the place -len(sep)
    start = F.col("_end") - F.col("_n") - F.lit(len(sep))
    piece = placed.select(F.concat(F.lit(sep), F.col("_t")).alias("_s"), start.alias("_at"))
    first = F.greatest(F.col("_at"), F.lit(0))
    last = F.col("_at") + F.length("_s") - 1
    blocks_of = F.when(last >= first, F.sequence(F.expr(f"greatest(_at, 0L) div {size}L"), F.expr(f"(_at + length(_s) - 1) div {size}L")))
    cut = piece.select("_s", "_at", F.explode(blocks_of).alias("block"))
    low = F.greatest(F.col("_at"), F.col("block") * size, F.lit(0))
    high = F.least(F.col("_at") + F.length("_s"), (F.col("block") + 1) * size)
    parts = cut.select("block", low.alias("_low"), F.substring("_s", (low - F.col("_at") + 1).cast("int"),
                                                                (high - low).cast("int")).alias("_s"))
    # a block's start is also what follows the block before
    lead = parts.where((F.col("block") > 0) & (F.col("_low") < F.col("block") * size + overlap))
    lead = lead.select((F.col("block") - 1).alias("block"), "_low", F.substring(
        "_s", F.lit(1), (F.col("block") * size + overlap - F.col("_low")).cast("int")).alias("_s"))
    held = spread(parts.unionByName(lead), by="block").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("_low", "_s"))).alias("_p"))
    return held.select("block", F.array_join(F.col("_p._s"), "").alias(text_col))


def joined_share(patterns: DataFrame, texts: DataFrame, pat_id: str, order: Sequence[str],
                 text_col: str = "text", sep: str = " ", size: int = 1 << 13, by: Sequence[str] = ()) -> DataFrame:
    """One row ``(n_total, n_found, ratio)``: the share of patterns found in the string of
    all texts joined in an order, across the ends of texts too; a row for each value of
    the patterns' columns ``by``."""
    longest = patterns.agg(F.max(F.length(text_col))).first()[0] or 1
    blocks = _stored(joined_blocks(texts, order, text_col, max(longest - 1, 0), sep, size), "blocks")
    return _share(patterns, blocks.select(text_col), text_col, by)


def containment_share(patterns: DataFrame, texts: DataFrame, pat_id: str, text_id: str,
                      text_col: str = "text") -> DataFrame:
    """One row ``(n_total, n_found, ratio)``: share of patterns found in some text.

    Equal patterns and equal texts are looked up once.
    """
    return _share(patterns, spread(texts.select(text_col).distinct()), text_col)


def _share(patterns: DataFrame, texts: DataFrame, text_col: str, by: Sequence[str] = ()) -> DataFrame:
    alike = patterns.groupBy(*by, text_col).agg(F.count(F.lit(1)).alias("_n"))
    found = _hits(alike.select(text_col).distinct(), texts, text_col).select("_p").distinct()
    held = alike.join(found, F.col(text_col) == F.col("_p"), "left")
    # equal patterns are one row here; a pattern that is not found has no _p
    return held.groupBy(*by).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_total"),
                                 F.coalesce(F.sum(F.when(F.col("_p").isNotNull(), F.col("_n"))), F.lit(0)).alias("n_found")) \
        .withColumn("ratio", F.expr("try_divide(n_found, n_total)"))
