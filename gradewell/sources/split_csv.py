"""Quoted multi-line CSV read by many tasks.

A task that begins in the middle of a file cannot see whether it is inside a quoted
field: a newline there may be text. Two passes over the lines settle it. The first
counts quotes by split; a split begins inside a field if the quotes before it are odd
in number. The second cuts every split into records, knowing how it begins. What a
split holds of a record that begins or ends elsewhere is a fragment; fragments name the
split in which their record begins, and are joined in order.

Quotes must come in pairs within a record, as in RFC 4180 (a quote inside a quoted field
is doubled). A file whose quotes do not pair up fails the read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RECORDS = "file long, split long, key long, kind string, first boolean, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, split, line)``: lines in order within a split; only newlines end them, so
    a carriage return inside a field is kept."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.xxhash64("_metadata.file_path").alias("file"),
                       F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"))


def _splits(lines: DataFrame) -> DataFrame:
    """``(file, split, inside, key)``: whether a split begins inside a field, and the split in
    which the record begun there begins. One row for each split of a file."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    odd = lines.groupBy("file", "split").agg(F.count_if(quotes % 2 == 1).alias("odd"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1
    known = odd.withColumn("inside", inside)
    # a record is left open here, unless the split is all inside one that began before
    opens = ((F.col("inside").cast("int") + F.col("odd")) % 2 == 1) & ~(F.col("inside") & (F.col("odd") == 0))
    known = known.withColumn("key", F.last(F.when(opens, F.col("split")), ignorenulls=True).over(before))
    last = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("split"))) == 1
    unpaired = last & ((F.col("inside").cast("int") + F.col("odd")) % 2 == 1)
    return known.select("file", "split", F.when(unpaired, F.raise_error(F.lit("a quoted field is not closed")))
                        .otherwise(F.col("inside")).cast("boolean").alias("inside"), "key")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and fragments of the splits that a task reads, one after another."""
    at, open_, state = None, [], {}

    def rows(out: list) -> pa.RecordBatch:
        names = [c.split()[0] for c in _RECORDS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    def row(kind: str, text: str, key) -> tuple:
        first = state["first"] and at[1] == 0
        state["first"] = False
        return (*at, key, kind, first, text)

    def closed() -> list:
        """The end of a split: what is still open goes on in the next one."""
        if not open_:
            return []
        kind = "middle" if state["head"] else "tail"
        return [row(kind, "\n".join(open_), state["key"] if state["head"] else at[1])]

    for batch in batches:
        places = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("file", "split")], 1)
        change = np.flatnonzero((places[1:] != places[:-1]).any(1)) + 1
        odd = pc.count_substring(batch.column("line"), '"').to_numpy(zero_copy_only=False) % 2 == 1
        for a, b in zip([0, *change], [*change, batch.num_rows]):
            if a == b:
                continue
            out: list = []
            if at != tuple(places[a]):
                if at is not None:
                    out += closed()
                at, open_ = tuple(int(x) for x in places[a]), []
                inside = batch.column("inside")[int(a)].as_py()
                state = {"inside": inside, "head": inside, "key": batch.column("key")[int(a)].as_py(), "first": True}
            after = (np.cumsum(odd[a:b]) + state["inside"]) % 2 == 1            # inside a field after each line
            lines = batch.column("line").slice(a, b - a).to_pylist()
            start = 0
            for end in np.flatnonzero(~after):
                text = lines[end] if start == end and not open_ else "\n".join(open_ + lines[start:end + 1])
                out.append(row("head", text, state["key"]) if state["head"] else row("record", text, None))
                open_, start, state["head"] = [], end + 1, False
            open_ = open_ + lines[start:]
            state["inside"] = bool(after[-1])
            if out:
                yield rows(out)
    if at is not None and open_:
        yield rows(closed())


def records(spark: SparkSession, path: str) -> DataFrame:
    """``(text, first)``: every record of the files as text, newlines in fields included;
    ``first`` is true of each file's first one."""
    lines = _lines(spark, path)
    # a row for each split: the file's size over spark.sql.files.maxPartitionBytes
    marked = lines.join(F.broadcast(_splits(lines)), ["file", "split"]).select("file", "split", "line", "inside", "key")
    cut = marked.mapInArrow(_cut, _RECORDS)
    parts = cut.where("kind != 'record'").groupBy("file", "key").agg(
        F.array_sort(F.collect_list(F.struct("split", "text"))).alias("parts"), F.max("first").alias("first"))
    joined = parts.select(F.array_join(F.col("parts.text"), "\n").alias("text"), "first")
    whole = cut.where("kind = 'record'").select("text", "first").unionByName(joined)
    return whole.select(F.regexp_replace("text", r"\r\z", "").alias("text"), "first")


def read_split_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """CSV files with quoted multi-line text, each split over tasks; a malformed record
    fails the read. The rows are those of ``files.read_csv``, in any order."""
    found = records(spark, path).where("text != ''")
    if header:
        found = found.where(~F.col("first"))
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    options = {"escape": '"', "mode": "FAILFAST", "multiLine": "true"}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nullable.fields)
    return found.select(F.from_csv("text", ddl, options).alias("r")).select("r.*")
