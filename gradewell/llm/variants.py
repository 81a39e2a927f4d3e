"""Spelling variants by permuterm rotations.

A word with its end marked, ``w$``, has a rotation for each place. Written with ``v``
the part after a place and ``u`` the part before it, the rotation ``v$u`` names both
parts. For a word ``u c v`` the rotation is ``v$u c``: without its last character, the
one at the place, it is the prefix that every word with another character there has
too, and the whole rotation of the word ``u v``. So replacements, insertions and
deletions at a place are one range of the sorted rotations:

* ``v$u`` itself, if ``u v`` is a word (at most one row), and
* ``v$u c`` for each word ``u c v`` (at most one row for each character).

A range holds at most one row more than the alphabet has characters. It is scanned
once: every row gets its number of neighbours there and the best of them, from the
range's count and its best two rows, without a row for each pair.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import by_bytes, staged

#: Marks a word's end; no letter of a word.
END = "$"

# What a run of letters is, and which letters are lower-cased.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def typed(prefix: int, run: str, every: int) -> str:
    """The run as it counts: where ``every`` divides the checksum of id and run, without
    one character. ``prefix`` is the checksum of the id and the colon."""
    h = zlib.crc32(run.encode("utf-8"), prefix)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, least_length: int = 6, least: int = 5, every: int = 199, id_col: str = "doc_id",
                text_col: str = "text", chunk_words: int = 1 << 18) -> DataFrame:
    """``(word, n)`` of the words of ``least_length`` characters that occur ``least`` times.

    Words are runs of letters with only A-Z lower-cased; of each (id, run) for which
    ``every`` divides the checksum, the copy lacks one character. Counts are added up in
    each task first, ``chunk_words`` distinct words at a time, so a frequent word is a
    row of each task at most.
    """
    def rows(total: Counter) -> pa.RecordBatch:
        words, n = zip(*total.items())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in by_bytes(batches):
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                prefix = zlib.crc32(f"{key}:".encode("utf-8"))
                for run, n in Counter(RUN.findall(text.translate(LOWER))).items():
                    if len(run) >= least_length:
                        word = typed(prefix, run, every)
                        if len(word) >= least_length:
                            total[word] += n
            if len(total) >= chunk_words:
                yield rows(total)
                total = Counter()
        if total:
            yield rows(total)

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = texts.mapInArrow(count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def numbered(words: DataFrame) -> DataFrame:
    """``(id, word, n)``: words with numbers in their code-point order, so that rows need
    not carry the words themselves."""
    ordered = words.select("word", "n").repartitionByRange("word").sortWithinPartitions("word")
    return staged(ordered.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words-numbered")


def _with_a_half(long: DataFrame) -> DataFrame:
    """Those long words that share a half with another one of fitting length. One edit
    leaves the first or the second half of the shorter word whole, so the others have no
    neighbour, and need no rotations."""
    size = F.length("word")
    keys = []
    for shorter in (size, size - 1):          # as the shorter word of a pair, or as the longer
        half = F.floor(shorter / 2).cast("int")
        keys += [F.xxhash64(F.lit("first"), shorter, F.substring("word", F.lit(1), half)),
                 F.xxhash64(F.lit("last"), shorter, F.substring("word", half - shorter, shorter - half))]
    halves = long.select("id", F.explode(F.array(*keys)).alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("c")).where("c > 1")
    return long.join(halves.join(shared, "half", "left_semi").select("id").distinct(), "id", "left_semi")


def rotations(words: DataFrame, plain: int = 64) -> DataFrame:
    """``(prefix, edited, id, n, leads)`` for ``words (id, word, n)``: for each word
    ``u c v`` and place the range ``v$u`` with the skipped character ``c``; and the whole
    rotations, with none.

    ``leads`` is false where the character before is the same: to leave out either gives
    the same word, and it counts once. A range of more than ``plain`` letters is
    named by 128 bits of its hashes, so the rows of a long word take room by its length,
    not by the square of it; one without a possible neighbour has no rows.
    """
    def name(p: Column) -> Column:
        marked = F.concat_ws("/", F.hex(F.xxhash64(p)), F.hex(F.xxhash64(F.lit(1), p)))
        return F.when(F.length(p) <= plain + 1, p).otherwise(marked).alias("prefix")

    size = F.length("word")
    long = _with_a_half(words.where(size >= plain)).where(size > plain)
    turns = (words.where(size <= plain).unionByName(long)
             .select("id", "word", "n", F.explode(F.sequence(F.lit(0), size)).alias("i")))
    before, after = F.expr("substring(word, 1, i)"), F.expr("substring(word, i + 2)")
    here = F.expr("substring(word, i + 1, 1)")
    skipped = (turns.where(F.col("i") < size)
               .select(name(F.concat(after, F.lit(END), before)), here.alias("edited"), "id", "n",
                       (here != F.expr("if(i = 0, '', substring(word, i, 1))")).alias("leads")))
    whole = turns.select(name(F.concat(F.expr("substring(word, i + 1)"), F.lit(END), before)),
                         F.lit("").alias("edited"), "id", "n", F.lit(True).alias("leads"))
    return skipped.unionByName(whole)


def ranges(words: DataFrame) -> DataFrame:
    """``(prefix, rows)``: the ranges with two words or more, their rows in order, the whole
    rotation first. A range has at most one row for each letter, and that one."""
    row = F.struct("edited", "id", "n", "leads")
    return (rotations(words).groupBy("prefix").agg(F.sort_array(F.collect_list(row)).alias("rows"))
            .where(F.size("rows") > 1))


def neighbours(words: DataFrame) -> DataFrame:
    """``(word, n, near, near_n)``: every pair of words one edit apart, both ways round, once.
    As many rows as there are such pairs; ``word_forms`` does without them."""
    words = numbered(words)
    pairs = (ranges(words).select("rows", F.explode("rows").alias("x"))
             .select("x", F.explode("rows").alias("y")).where("x.edited != y.edited")
             .where("(x.edited != '' or y.leads) and (y.edited != '' or x.leads)")
             .select(F.col("x.id").alias("id"), F.col("y.id").alias("near_id")).distinct())
    near = words.select(F.col("id").alias("near_id"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.join(words, "id").join(near, "near_id").select("word", "n", "near", "near_n")


def _scanned(words: DataFrame) -> DataFrame:
    """``(id, n_near, best)`` of each word in each range: how many neighbours it has
    there, and the best, that is of largest n and then least, from the range's best two."""
    def rank(r: Column) -> Column:          # ascending: larger n first, then the word
        return F.struct((-r["n"]).alias("less"), r["id"].alias("id"), r["leads"].alias("leads"))

    scanned = ranges(words).select(
        F.explode("rows").alias("x"),
        F.when(F.col("rows")[0]["edited"] == "", F.col("rows")[0]).alias("short"),
        F.filter("rows", lambda r: r["edited"] != "").alias("long"))
    leading = F.filter("long", lambda r: r["leads"])
    scanned = scanned.select("x", "short", F.size("long").alias("n_long"), F.size(leading).alias("n_leading"),
                             F.slice(F.array_sort(F.transform("long", rank)), 1, 2).alias("order"),
                             F.array_min(F.transform(leading, rank)).alias("leading"))
    is_short = F.col("x.edited") == ""
    short = F.when(F.col("x.leads") & F.col("short").isNotNull(), rank(F.col("short")))
    first, second = F.get("order", F.lit(0)), F.get("order", F.lit(1))
    # a longer word's best: the first of the other longer ones, or the shorter one
    near = F.when(is_short, F.col("leading")).otherwise(F.least(F.when(first["id"] != F.col("x.id"), first)
                                                                .otherwise(second), short))
    count = (F.when(is_short, F.col("n_leading"))
             .otherwise(F.col("n_long") - 1 + F.when(short.isNotNull(), 1).otherwise(0)))
    return scanned.select("x.id", count.alias("n_near"), near.alias("best")).where("n_near > 0")


def word_forms(words: DataFrame, times: int = 5) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for each row of ``words (word, n)``.

    ``n_near`` words differ from a word by one inserted, deleted or replaced character.
    The one of largest n (ties: least in code-point order) is its form if it has ``times``
    times its n or more; ``root`` is where the forms lead. ``words`` must name a word once.
    """
    words = numbered(words)
    near = (_scanned(words).groupBy("id").agg(F.sum("n_near").alias("n_near"),
                                              F.min(F.struct("best.less", "best.id")).alias("best")))
    base = words.join(near, "id", "left").withColumn("form_n", -F.col("best.less"))
    strong = F.col("form_n") >= F.col("n") * times
    forms = staged(base.select("id", "word", F.when(strong, F.col("best.id")).alias("form_id"), "n",
                               F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                               F.when(strong, F.col("form_n")).alias("form_n")), "word-forms")
    roots = _roots(forms.where("form_id is not null").select("id", F.col("form_id").alias("root_id")))
    out = forms.join(roots, "id", "left")
    for name in ("form", "root"):
        out = out.join(words.select(F.col("id").alias(f"{name}_id"), F.col("word").alias(name)), f"{name}_id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(steps: DataFrame) -> DataFrame:
    """``(id, root_id)``: forms followed to the last, by doubling. A step multiplies n, so
    a chain is short and so is this loop."""
    while True:
        ahead = steps.select(F.col("id").alias("root_id"), F.col("root_id").alias("next"))
        moved = staged(steps.join(ahead, "root_id", "left")
                       .select("id", F.coalesce("next", "root_id").alias("root_id"),
                               F.col("next").isNotNull().alias("moved")), "word-roots")
        steps = moved.select("id", "root_id")
        if moved.where("moved").isEmpty():
            return steps


def spelling_variants(docs: DataFrame, least_length: int = 6, least: int = 5, times: int = 5, every: int = 199,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``: the words of all texts and their forms.

    A null text has no words, a null id counts as the empty string in the checksum,
    repeated rows count each; an empty table gives no rows; other columns are not read.
    """
    words = staged(word_counts(docs, least_length, least, every, id_col, text_col), "word-counts")
    return word_forms(words, times)
