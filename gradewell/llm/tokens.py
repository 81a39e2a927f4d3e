"""Token counts: batch encoding in Arrow functions that return lengths only.

The counts are those of the tokenizer library on each whole text. Texts are
encoded in batches balanced by bytes; a text longer than ``long_chars`` is cut
at safe boundaries first, so that no call holds more than a bounded text.

A boundary is safe at a single space between two other characters: the space
becomes the word mark that leads the next piece, no piece of the vocabulary
holds that mark after another character (checked when the model is loaded), and
the library puts the same mark before the text it is given. The space itself is
left out of both parts, and the counts of the parts add up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import by_bytes, id_and_text, once

MARK = "▁"
_SAFE = re.compile(r"(?<=[^ ▁]) (?=[^ ▁])")


def safe_parts(text: str, size: int) -> list[str]:
    """Parts of about ``size`` characters, cut at safe single spaces only. A
    stretch without a safe space stays whole."""
    parts, start = [], 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        parts.append(text[start:cut.start()])
        start = cut.end()
    parts.append(text[start:])
    return parts


def load_pieces(path: str):
    """A sentencepiece processor and whether spaces are safe boundaries for it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    safe = not any(MARK in p.lstrip(MARK) for p in pieces)
    # the mark is put before a text, and spaces within it are kept as they are
    safe &= (model.encode("a") == model.encode("a b")[:len(model.encode("a"))]
             and len(model.encode("a  b ")) > len(model.encode("a b")))
    return model, safe


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 4096, long_chars: int = 20_000, batch_bytes: int = 1 << 20) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row for each input row.

    Null and empty texts have 0 bytes and 0 tokens; a null id stays null;
    repeated rows each come back; an empty table gives an empty result. Other
    columns of the input are not read, so their names cannot clash.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, safe = once(("pieces", model_path), lambda: load_pieces(model_path))
        for batch in by_bytes(batches, limit=batch_bytes):
            texts = batch.column("text").to_pylist()
            parts, owner = [], []
            for i, text in enumerate(texts):
                cut = safe_parts(text, long_chars) if safe else [text]
                parts += cut
                owner += [i] * len(cut)
            counts = [0] * len(texts)
            for i, ids in zip(owner, model.encode(parts, num_threads=1)):
                counts[i] += len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_length(batch.column("text")).cast(pa.int64()),
                 pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return (id_and_text(docs, id_col, text_col)
            .mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
