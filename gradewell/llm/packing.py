"""Best-fit packing of token pieces into sequences, under several capacities.

A piece weighs its tokens, one document and its attention cost (the square of
its tokens). Pieces go, longest first, to the open sequence that fits them best
by a vector rule: the least norm of what would be left of the capacities, or the
greatest dot product of the piece and what is left, both weighted.

Pieces are dealt at random into groups of about ``group_pieces``, each packed by
one task. The number of groups follows the number of pieces, so a task's work is
bounded; the loss is a fraction of a sequence a group, since each group has
pieces of all lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import by_bytes, id_and_text, staged
from gradewell.llm.encode import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each row's ids and end id; only a document of
    more than ``capacity`` ids is cut, the rest of the division coming first."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in by_bytes(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text) + end
                n = len(ids) // 4
                stop = n % capacity or capacity
                if n <= capacity:
                    stop = n
                start = piece = 0
                while start < n:
                    rows.append((doc, piece, start, stop - start, zlib.crc32(ids[4 * start:4 * stop])))
                    start, stop, piece = stop, stop + capacity, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_and_text(docs, id_col, text_col).mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, capacities: tuple[int, int, int], weights=(1.0, 0.1, 0.1),
             rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. ``capacities``: tokens, documents and
    attention cost of a bin; every piece alone must fit them."""
    lengths = np.asarray(lengths, np.int64)
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return bins, offsets
    if lengths.max() > capacities[0] or int(lengths.max()) ** 2 > capacities[2] or capacities[1] < 1:
        raise ValueError("a piece exceeds the capacities")
    scale = np.asarray(weights, float) / np.asarray(capacities, float)
    least = int(lengths.min())
    left = np.empty((3, n), np.int64)           # what is left of the open bins' capacities
    names = np.empty(n, np.int64)
    opened = used = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        need = np.array([[size], [1], [size * size]])
        room = left[:, :opened]
        fits = np.flatnonzero((room >= need).all(0))
        if len(fits):
            after = room[:, fits]
            if rule == "norm":
                rest = (after - need) * scale[:, None]
                at = fits[np.argmin((rest * rest).sum(0))]
            else:
                at = fits[np.argmax(((after * scale[:, None]) * (need * scale[:, None])).sum(0))]
        else:
            at, names[opened], left[:, opened] = opened, used, capacities
            opened, used = opened + 1, used + 1
        bins[i], offsets[i] = names[at], capacities[0] - left[0, at]
        left[:, at] -= need[:, 0]
        if left[0, at] < least or left[1, at] < 1 or left[2, at] < least * least:
            opened -= 1                          # nothing fits any more: the last open bin takes its place
            left[:, at], names[at] = left[:, opened], names[opened]
    return bins, offsets


def pack(pieces: DataFrame, capacities: tuple[int, int, int], group_pieces: int = 8192,
         rule: str = "norm") -> DataFrame:
    """Sequence and offset of each piece. ``pieces`` must be a stored table."""
    groups = max(1, -(-pieces.count() // group_pieces))

    def place(table: pa.Table) -> pa.Table:
        bins, offsets = best_fit(table["length"].to_numpy(), capacities, rule=rule)
        first = table["group"][0].as_py() << 32
        return (table.drop_columns(["group"])
                .append_column("sequence_id", pa.array(bins + first))
                .append_column("offset", pa.array(offsets)))

    # dealt by place in the stored table, so neither repeated rows nor a hot id fill a group
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(place, PACKED)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024,
                   max_docs: int | None = None, max_cost: int | None = None, id_col: str = "doc_id",
                   text_col: str = "text", group_pieces: int = 8192, rule: str = "norm") -> DataFrame:
    """Pack all rows into sequences of at most ``capacity`` ids.

    ``max_docs`` pieces and an attention cost of ``max_cost`` a sequence are
    further limits; by default they are as wide as the tokens allow. Null and
    empty texts give the end id alone; a null id stays null; repeated rows are
    packed each; of equal fits the first opened wins; an empty table gives an
    empty result; other columns are not read.
    """
    limits = (capacity, max_docs or capacity, max_cost or capacity * capacity)
    pieces = staged(token_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col), "pieces")
    return pack(pieces, limits, group_pieces, rule)
