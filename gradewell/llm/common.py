"""Helpers shared by the text operators: tables, staged results, scans."""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Whether a query's shuffle files go when it ends, not when the driver happens to collect its plan.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps neither
    recompute it nor depend on the executors that made it. Its shuffle files go
    when it is written."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    if _PASSING:
        _PASSING[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


_PASSING: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession):
    """Within, staged tables pass: at the end those are deleted that were not given to
    the function that this yields, which returns its table. What stays must not read
    what goes, so it is a staged table too."""
    mine: list[str] = []

    def keep(table_: DataFrame) -> DataFrame:
        if getattr(table_, "staged_at", None) is None:
            table_ = staged(table_, "kept")
        if table_.staged_at in mine:
            mine.remove(table_.staged_at)
            if len(_PASSING) > 1:
                _PASSING[-2].append(table_.staged_at)
        return table_

    _PASSING.append(mine)
    try:
        yield keep
    finally:
        _PASSING.pop()
        for path in mine:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        # shuffle files go once the driver has collected the plans that made them
        gc.collect()
        spark._jvm.System.gc()


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under fixed names; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_hash(text: Column) -> list[Column]:
    """Two hashes of a text, 128 bits together; rows with the same id are told apart by them."""
    return [F.xxhash64(text).alias("ta"), F.xxhash64(F.lit(1), text).alias("tb")]


def by_bytes(batches: Iterable[pa.RecordBatch], column: str = "text",
             limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice holds about ``limit`` bytes of text
    (one row at least): the work done at a time follows bytes, not rows."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def plain_texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; a null one is empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


_SPACED = re.compile(r" +[^ ]*|[^ ]+")


def space_chunks(text: str) -> list[str]:
    """Cut a text before its runs of spaces; each run leads the chunk after it.

    ``"".join(space_chunks(t)) == t``.
    """
    if "  " in text:
        return _SPACED.findall(text)
    first, *rest = text.split(" ")
    return ([first] if first else []) + [" " + w for w in rest]


class Remembered(dict):
    """Results by key, made when first asked for.

    Emptied when it holds ``limit`` keys, so its memory is bounded; what it
    returns does not depend on what it holds.
    """

    def __init__(self, make: Callable[[str], object], limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


_LOADED: dict = {}


def once(key, make: Callable):
    """One object of a kind in each Python worker, such as a loaded tokenizer."""
    if key not in _LOADED:
        _LOADED[key] = make()
    return _LOADED[key]


def bitmap(df: DataFrame, column: str, bits: int = 22) -> bytes:
    """Which residues modulo ``2**bits`` the longs of a column have, as a map of
    ``2**bits`` bits. Its size is fixed (512 KiB), whatever the input: tasks use
    it to leave out rows early, and an exact join follows."""
    import numpy as np

    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    rows = (df.select(F.shiftright(slot, 5).cast("int").alias("word"),
                      F.expr(f"shiftleft(1L, int({column} & 31))").alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow())
    words = np.zeros(1 << (bits - 5), np.uint32)
    words[rows["word"].to_numpy()] = rows["bit"].to_numpy().astype(np.uint32)
    return words.tobytes()


def in_bitmap(values, words: bytes):
    """Boolean array: which longs (numpy int64) have their bit set."""
    import numpy as np

    table_ = np.frombuffer(words, np.uint32)
    slot = values.astype(np.uint64) & np.uint64(len(table_) * 32 - 1)
    return (table_[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0
