"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set holds the 64-bit hashes of its word shingles; its sketch is the
``k`` least. Documents with equal sets form a class from the start. Two sets with
the wanted similarity share far more than ``keep`` of their sketch values, so
they share one of the ``k - keep + 1`` rarest: those values make the inverted
lists. Candidates are filtered by the similarity estimated on the least ``k``
values of both sketches together, and confirmed by the exact similarity of the
full sets.

Texts that share much, though not enough, keep long lists alive. For the texts in
such lists the sketch is deepened to the whole set: two sets with the wanted
similarity share one of the first few of their rarest values (a fifth of the
larger set's, a ninth of the smaller's), while texts that differ more begin with
values of their own, and their lists fall apart. Entries of whole sets also carry
256 parity bits, one for each residue of the values: two sets differ in at least
as many values as these bits differ, so pairs that differ in too many are never made.

With k = 40 a pair at similarity 0.8 shares 32 of 40 values on average; fewer
than ``keep`` = 15 happens less than once in ten million pairs, and for sets of
at most k shingles the sketch is the set and nothing is left to chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import bitmap, by_bytes, id_and_text, in_bitmap, passing, staged, text_hash
from gradewell.llm.links import linked_classes

# A-Z are lowered, all else stays; words end at ASCII white space.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5]


def shingle_set(text: str, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of ``size`` words; of fewer
    words, the hash of the whole sequence; of none, nothing."""
    from xxhash import xxh3_64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    n = min(size, len(words))
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    x = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        odd = np.uint64(_ODD[j % 4] + 2 * (j // 4))
        x = (x ^ (x >> np.uint64(31))) * odd + h[j:j + len(x)] * np.uint64(_ODD[(j + 1) % 4])
    for shift, odd in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return np.unique(x ^ (x >> np.uint64(32)))


def _digest(values: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(values.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


#: Long words of parity bits, and keys named before their own one, in a whole set's entries.
PARITY_WORDS, PREVIOUS = 4, 4


def parity(values: np.ndarray) -> np.ndarray:
    """For each residue of the values, whether an odd number of them has it, as bits."""
    bits = 64 * PARITY_WORDS
    odd = np.bincount((values.astype(np.uint64) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def sketches(docs: DataFrame, size: int, k: int) -> DataFrame:
    """All columns but ``text``, and ``n_shingles, ha, hb, sketch``: set size, digest and least values."""
    others = docs.drop("text").schema
    names = others.fieldNames()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            sets = [shingle_set(t, size) for t in batch.column("text").to_pylist()]
            digests = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
                 _lists([s[:k] for s in sets])], [*names, "n_shingles", "ha", "hb", "sketch"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in others)
    return docs.mapInArrow(sketch, f"{kinds}, n_shingles long, ha long, hb long, sketch array<long>")


def full_sets(docs: DataFrame, size: int, wanted: bytes) -> DataFrame:
    """``(ha, hb, values, parity)`` of the documents whose id may be wanted."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            rows = batch.filter(pa.array(in_bitmap(ids, wanted)))
            sets = [shingle_set(t, size) for t in rows.column("text").to_pylist()]
            digests = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
                 _lists(sets), _lists([parity(s) for s in sets])], ["ha", "hb", "values", "parity"])

    return docs.mapInArrow(read, "ha long, hb long, values array<long>, parity array<long>")


def inverted_lists(classes: DataFrame, k: int, keep: int) -> DataFrame:
    """List entries of the rarest sketch values of each class that other classes
    have as well: ``(key, node, indexed, trait)``. The trait holds the set's size and
    how many of its values surely come before the key in the order of rareness."""
    values = classes.select("node", "n_shingles", F.explode("sketch").alias("key"))
    shared = values.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    held = F.least(F.col("n_shingles"), F.lit(k))
    need = F.ceil(held * F.lit(keep) / F.lit(k))
    common = (values.join(shared, "key").groupBy("node", "n_shingles")
              .agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("common")))
    # values that no other class has come first in the order of rareness
    prefix = F.greatest(F.lit(0), held - need + 1 - (held - F.size("common")))
    return (common.select("node", "n_shingles", F.explode(F.slice("common", F.lit(1), prefix.cast("int"))).alias("e"))
            .select(F.col("e.key").alias("key"), "node", F.lit(True).alias("indexed"),
                    F.struct(F.col("n_shingles").alias("n"), F.lit(0).alias("before"),
                             F.lit(None).cast("array<long>").alias("parity"),
                             F.lit(None).cast("array<long>").alias("previous")).alias("trait")))


def deep_lists(sets: DataFrame, percent: int) -> DataFrame:
    """List entries of whole sets ``(node, values, parity)``. A set is indexed under so many
    of its rarest values that a larger set with the wanted similarity shares one
    of them, and looks up so many that a smaller one does."""
    size = F.size("values")
    values = sets.select("node", size.alias("n"), F.explode("values").alias("key"))
    shared = values.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    common = (values.join(shared, "key").groupBy("node", "n")
              .agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("common"))
              .join(sets.select("node", "parity"), "node"))
    alone = F.col("n") - F.size("common")           # values of its own come first
    looks = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    holds = F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)) + 1 - alone

    def entry(e, i):
        previous = F.slice("common", F.greatest(i - PREVIOUS + 1, F.lit(1)), F.least(i, F.lit(PREVIOUS)))
        return F.struct(i.alias("place"), e["key"].alias("key"), previous["key"].alias("previous"))

    looked = F.slice("common", F.lit(1), F.greatest(looks, F.lit(0)).cast("int"))
    return (common.select("node", "n", "parity", F.size("common").alias("shared"), holds.alias("holds"),
                          F.explode(F.transform(looked, entry)).alias("e"))
            .select(F.col("e.key").alias("key"), "node", (F.col("e.place") < F.col("holds")).alias("indexed"),
                    F.struct(F.col("n").cast("long").alias("n"),
                             (F.col("n") - F.col("shared") + F.col("e.place")).alias("before"),
                             "parity", F.col("e.previous").alias("previous")).alias("trait")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                    percent: int = 80, k: int = 40, keep: int = 15) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row for each row.

    Documents are linked if their sets of ``size``-word shingles have a Jaccard
    similarity of ``percent`` or more; ``component_id`` is the least id that can
    be reached. A text without words (null and empty ones too) has an empty set
    and is linked with nothing. Rows with the same id share their fate if their
    texts are linked and are judged each by its own text if not. A null id is
    never the least one; where all ids of a class are null, it is kept and its
    component is null. An empty table gives an empty result; other columns are
    not read.
    """
    return (judged(id_and_text(docs, id_col, text_col), size, percent, k, keep)
            .select("doc_id", "n_shingles", "component_id", "kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                percent: int = 80, k: int = 40, keep: int = 15) -> DataFrame:
    """The table with one row of each class of ``near_duplicates``, and all rows
    without words: among equal ids the text with the least hashes, among equal
    texts of one id any row."""
    data = id_and_text(docs, id_col, text_col)
    rows = judged(data.select("doc_id", *text_hash(F.col("text")), "text"), size, percent, k, keep)
    rows = staged(rows.where("kept").groupBy("comp", "doc_id", "ta", "tb").agg(F.count("*").alias("n")), "judged")
    best = F.min(F.struct("doc_id", "ta", "tb", "n")).alias("best")
    picked = rows.where("comp IS NOT NULL").groupBy("comp").agg(best).select("best.*")
    wordless = rows.where("comp IS NULL").select("doc_id", "ta", "tb", F.lit(1).cast("long").alias("n"))
    picked = staged(picked.unionByName(wordless).select(*[F.col(c).alias(f"__{c}") for c in ("doc_id", "ta", "tb", "n")]),
                    "picked")
    ta, tb = text_hash(F.coalesce(F.col(text_col), F.lit("")))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__doc_id")) & (ta == F.col("__ta")) & (tb == F.col("__tb"))
    out = docs.join(picked.where("__n = 1"), same, "left_semi")
    repeated = picked.where("__n > 1")
    if not repeated.isEmpty():
        once = docs.join(repeated, same).dropDuplicates(["__doc_id", "__ta", "__tb"])
        out = out.unionByName(once.select(docs.columns))
    return out


def judged(data: DataFrame, size: int, percent: int, k: int, keep: int) -> DataFrame:
    """Rows of ``data (doc_id, text, ...)`` without their texts, with ``n_shingles``,
    ``component_id`` and ``kept`` of ``near_duplicates``, and ``comp``: the class,
    null for a text without words."""
    with passing(data.sparkSession) as stays:          # a sketch is kept once for each set, not for each row
        every = staged(sketches(data, size, k), "sketches")
        classes = stays(staged(every.where("n_shingles > 0").groupBy("ha", "hb").agg(
            F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
            .withColumn("node", F.monotonically_increasing_id()), "sets"))
        rows = stays(staged(every.drop("sketch"), "rows"))

    def compatible(x, y):
        # sizes, and what can be common from the first common value on, must allow the similarity
        sizes = F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * percent
        rest = F.least(x["n"] - x["before"], y["n"] - y["before"])
        apart = reduce(lambda s, t: s + t, [F.bit_count(x["parity"][i].bitwiseXOR(y["parity"][i]))
                                            for i in range(PARITY_WORDS)])
        close = F.coalesce(apart * (100 + percent) <= (x["n"] + y["n"]) * (100 - percent), F.lit(True))
        return sizes & (rest * (100 + percent) >= (x["n"] + y["n"]) * percent) & close

    def first(x, y):
        # a pair with a common key among the ones just before was made under that key
        return ~F.coalesce(F.arrays_overlap(x["previous"], y["previous"]), F.lit(False))

    def verify(pairs: DataFrame) -> DataFrame:
        near = pairs
        for side in ("a", "b"):
            near = near.join(classes.select(F.col("node").alias(side), F.col("sketch").alias(f"s{side}")), side)
        union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
        both = F.size(F.array_intersect(F.array_intersect(union, F.col("sa")), F.col("sb")))
        near = staged(near.where(both * k >= F.lit(keep) * F.size(union)).select("a", "b"), "candidates")
        return exact(near)

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = staged(classes.select("node", "ha", "hb", "least").join(nodes, "node"), "wanted")
        sets = full_sets(data, size, bitmap(wanted.select(F.coalesce("least", F.lit(0)).alias("least")), "least"))
        return staged(wanted.select("node", "ha", "hb").join(sets, ["ha", "hb"])
                      .select("node", "values", "parity").dropDuplicates(["node"]), "values")

    def refine(nodes: DataFrame) -> DataFrame:
        return staged(deep_lists(sets_of(nodes), percent), "deep")

    def exact(near: DataFrame) -> DataFrame:
        sets = sets_of(near.select(F.col("a").alias("node")).union(near.select("b")).distinct())
        # the smaller end of a pair may be one hub of very many: its set is dealt to several tasks
        parts = near.groupBy("a").agg(F.ceil(F.count("*") / 4096).cast("int").alias("parts"))
        dealt = (near.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
                 .join(sets.select(F.col("node").alias("b"), F.col("values").alias("vb")), "b"))
        hubs = (sets.withColumnRenamed("node", "a").join(parts, "a")
                .select("a", F.col("values").alias("va"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
        both = F.size(F.array_intersect("va", "vb"))
        return (dealt.join(hubs, ["a", "part"]).withColumn("both", both)
                .where(100 * F.col("both") >= percent * (F.size("va") + F.size("vb") - F.col("both"))).select("a", "b"))

    with passing(data.sparkSession) as stays:
        entries = staged(inverted_lists(classes, k, keep), "entries")
        linked = stays(linked_classes(entries, verify, compatible, refine, first))
    with_comp = classes.select("node", "ha", "hb", "least").join(linked, "node", "left").withColumn(
        "comp", F.coalesce("comp", "node"))
    least = with_comp.groupBy("comp").agg(F.min("least").alias("component_id"))
    of_set = with_comp.join(least, "comp").select("ha", "hb", "comp", "component_id")
    component = F.when(F.col("comp").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return (rows.join(of_set, ["ha", "hb"], "left").withColumn("component_id", component)
            .select(*data.drop("text").columns, "n_shingles", "comp", "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept")))
