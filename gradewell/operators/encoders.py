"""Encoders as plug-ins: texts to vectors, a stage of the feature store.

An encoder is a function of a list of texts to a matrix. It is made once in each
Python worker by its factory, as a model is loaded there, and sees bounded batches.
``hashed_units`` makes encoders that need no model file; any other factory will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Mapping
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]

#: Texts that an encoder sees at a time.
BATCH = 64

_MADE: dict[str, Encoder] = {}


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero row stays zero."""
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(size > 0, size, 1.0)


def _hashed(texts: list[str], width: int, gram: int, seed: int) -> np.ndarray:
    out = np.zeros((len(texts), width))
    for row, text in zip(out, texts):
        text = text.lower()
        units = text.split() if not gram else [text[i:i + gram] for i in range(len(text) - gram + 1)]
        for unit in units:
            h = zlib.crc32(unit.encode("utf-8", "surrogatepass"), seed)
            row[h % width] += 1.0 if h >> 31 else -1.0
    return unit_rows(out)


def hashed_units(width: int, gram: int = 0, seed: int = 0) -> Encoder:
    """Signed counts of words (or of runs of ``gram`` characters) by hash, as unit vectors."""
    return partial(_hashed, width=width, gram=gram, seed=seed)


def encoded(df: DataFrame, id_col: str, text_col: str, factories: Mapping[str, Callable[[], Encoder]],
            name_col: str = "encoder") -> DataFrame:
    """``(id, encoder, vec)``: each text by each encoder, in one pass over the texts. A null
    text is empty; rows with a null id come back with it."""
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, make in factories.items():
            if name not in _MADE:
                _MADE[name] = make()
        for pdf in batches:
            for at in range(0, len(pdf), BATCH):
                part = pdf.iloc[at:at + BATCH]
                texts = [t or "" for t in part["text"]]
                for name in factories:
                    vecs = np.asarray(_MADE[name](texts), np.float64)
                    yield pd.DataFrame({"id": part["id"].to_numpy(), "encoder": name, "vec": list(vecs)})

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInPandas(fn, f"id {kind}, encoder string, vec array<double>")
    return out.select(F.col("id").alias(id_col), F.col("encoder").alias(name_col), "vec")
