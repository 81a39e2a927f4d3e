"""Token output: one wavelet matrix for each shard of token ids.

A shard holds the ids of consecutive documents (ascending id). Its record has

* ``planes``: one bit plane for each bit of the largest id, highest first; a
  plane is the current order's bits, after which ids with bit 0 go before those
  with bit 1, both stably;
* ``ranks``: ones before each block of 512 bits of a plane, as 32-bit counts;
* ``samples``: for ones and for zeros, the block that holds every 512th of them;
* ``zeros``: zeros of each plane, and the document starts and ids.

A plane takes an eighth of a byte an id, so ids of 16 bits take two bytes and an
eighth of rank and select data. Access and counting need one rank in each plane, the
place of an occurrence one rank and one select: each reads one block of 512 bits (a
select a few more counts), straight from the packed bytes, of which nothing has to be
unpacked first. The bytes (``MAGIC``, header, arrays) are stored with the shard's bounds as a
row of a Parquet table in the shared folder, so that any executor and any store that
Spark reads will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm.common import by_bytes, id_and_text
from gradewell.llm.encode import encoder
from gradewell.session import scratch_path

MAGIC = b"GWM2"
BLOCK = 512
_HEADER = struct.Struct("<4sBIQ")

SHARD_SCHEMA = ("part int, shard int, part_start long, first_doc long, last_doc long, n_docs long, "
                "n_tokens long, body binary")


class WaveletMatrix:
    """Rank and select over the ids of one shard."""

    def __init__(self, ids: np.ndarray | None = None):
        if ids is None:
            return
        ids = np.asarray(ids)
        self.n = len(ids)
        most = int(ids.max()) if self.n else 0
        self.levels = max(1, most.bit_length())
        ids = ids.astype(np.uint16 if most < 1 << 16 else np.uint32)
        self.bits, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            one = (ids & ids.dtype.type(1 << level)).astype(bool)
            self.bits.append(np.packbits(one, bitorder="little"))
            zero = ids.compress(~one)                  # in half the time of a mask as an index
            self.zeros.append(len(zero))
            ids = np.concatenate([zero, ids.compress(one)])
        self._index()

    def _index(self) -> None:
        """Ones before each block of each plane, and the blocks of every 512th bit of a kind."""
        self.ranks, self.samples = [], ([], [])
        for plane in self.bits:
            padded = np.zeros(-(-len(plane) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
            padded[:len(plane)] = plane
            ones = np.bitwise_count(padded.view(np.uint64).reshape(-1, BLOCK // 64)).sum(1, dtype=np.uint32)
            ranks = np.concatenate([[0], np.cumsum(ones, dtype=np.uint32)]).astype(np.uint32)
            self.ranks.append(ranks)
            before = np.minimum(np.arange(len(ranks), dtype=np.int64) * BLOCK, self.n)
            for kind, counts in enumerate((before - ranks, ranks.astype(np.int64))):
                every = np.arange(0, int(counts[-1]), BLOCK)
                self.samples[kind].append((np.searchsorted(counts, every, "right") - 1).astype(np.uint32))

    def _bit(self, level: int, i: np.ndarray) -> np.ndarray:
        return (self.bits[level][i >> 3] >> (i & 7).astype(np.uint8)) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // BLOCK
        part = self.bits[level][block * BLOCK // 8: i // 8]
        ones = int(self.ranks[level][block]) + int(np.bitwise_count(part).sum())
        rest = i & 7
        return ones + (int(self.bits[level][i // 8]) & ((1 << rest) - 1)).bit_count() if rest else ones

    def access(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for level in range(self.levels):
            one = int(self._bit(level, np.int64(i)))
            ones = self._rank1(level, i)
            value = value << 1 | one
            i = self.zeros[level] + ones if one else i - ones
        return value

    def rank(self, value: int, i: int) -> int:
        """How often the id occurs among the first i."""
        if value >> self.levels:
            return 0
        start, end = 0, i
        for level in range(self.levels):
            a, b = self._rank1(level, start), self._rank1(level, end)
            if value >> (self.levels - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        return end - start

    def _select(self, level: int, one: int, k: int) -> int:
        """The place of bit k (from 0) of a kind in a plane: from the sampled block before
        it, along the counts to its own, and there to the byte and the bit."""
        ranks, plane = self.ranks[level], self.bits[level]
        before = lambda b: int(ranks[b]) if one else min(b * BLOCK, self.n) - int(ranks[b])
        block = int(self.samples[one][level][k // BLOCK])
        while before(block + 1) <= k:
            block += 1
        left = k - before(block)
        at = block * BLOCK // 8
        bits = np.unpackbits(plane[at:at + BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == one)[left])

    def select(self, value: int, k: int) -> int:
        """The place of occurrence k (from 0) of the id; -1 if there are fewer. Down the
        planes by rank to where the id's occurrences lie, and up again by select."""
        if value >> self.levels or k < 0:
            return -1
        start, end = 0, self.n
        for level in range(self.levels):
            a, b = self._rank1(level, start), self._rank1(level, end)
            if value >> (self.levels - 1 - level) & 1:
                start, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, end = start - a, end - b
        if end - start <= k:
            return -1
        place = start + k
        for level in range(self.levels - 1, -1, -1):
            one = value >> (self.levels - 1 - level) & 1
            place = self._select(level, one, place - self.zeros[level] if one else place)
        return place

    def to_ids(self) -> np.ndarray:
        """All ids in order, by undoing the stable moves plane by plane."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            one = np.unpackbits(self.bits[level], count=self.n, bitorder="little").astype(bool)
            back = np.empty(self.n, kind)
            back[np.flatnonzero(~one)] = ids[:self.zeros[level]]
            back[np.flatnonzero(one)] = ids[self.zeros[level]:] | kind(1 << (self.levels - 1 - level))
            ids = back
        return ids

    def to_bytes(self, doc_ends: np.ndarray) -> bytes:
        """The planes, their rank and select data and the documents' ends, packed."""
        sizes = np.array([len(x) for kind in self.samples for x in kind], "<u8")
        return b"".join([_HEADER.pack(MAGIC, self.levels, len(doc_ends), self.n),
                         np.asarray(self.zeros, "<u8").tobytes(), np.asarray(doc_ends, "<u8").tobytes(), sizes.tobytes(),
                         *(p.tobytes() for p in self.bits), *(r.tobytes() for r in self.ranks),
                         *(x.tobytes() for kind in self.samples for x in kind)])

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[WaveletMatrix, np.ndarray]:
        """A matrix that reads the packed bytes where they are."""
        magic, levels, n_docs, n = _HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        at = _HEADER.size

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self = cls()
        self.n, self.levels = n, levels
        self.zeros = take("<u8", levels).astype(int).tolist()
        ends, sizes = take("<u8", n_docs), take("<u8", 2 * levels).astype(int)
        self.bits = [take(np.uint8, -(-n // 8)) for _ in range(levels)]
        blocks = -(-(-(-n // 8)) // (BLOCK // 8))
        self.ranks = [take("<u4", blocks + 1) for _ in range(levels)]
        samples = [take("<u4", k) for k in sizes]
        self.samples = samples[:levels], samples[levels:]
        return self, ends


def write_shards(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1,
                 id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 1 << 20,
                 partitions: int | None = None) -> None:
    """Write the shards of all texts, in ascending id, as a Parquet table.

    Each document gives its ids and then ``end_id``. Null and empty texts give
    the end id alone; rows with a null id come first; rows with the same id
    follow one another in text order, and many of them spread over tasks. A document is never cut, so a shard holds
    ``shard_tokens`` ids or, if its last document is long, more.
    """
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        encode = encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        docs_, parts, size, done = [], [], 0, 0

        def flush():
            nonlocal docs_, parts, size, shard, done
            ids = np.frombuffer(b"".join(parts), "<u4")
            ends = np.cumsum([len(p) // 4 for p in parts])
            # the ids of the documents go with their ends; a null id is kept as a flag
            body = _pack_docs(docs_) + WaveletMatrix(ids).to_bytes(ends)
            row = [part, shard, done, docs_[0], docs_[-1], len(docs_), len(ids), body]
            shard, done, docs_, parts, size = shard + 1, done + len(ids), [], [], 0
            kinds = (pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)],
                                              [c.split()[0] for c in SHARD_SCHEMA.split(", ")])

        for batch in by_bytes(batches, limit=2 << 20):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text)
                docs_.append(doc)
                parts.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= shard_tokens:
                    yield flush()
        if docs_:
            yield flush()

    data = id_and_text(docs, id_col, text_col)
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the ranges also go by the texts' first characters, so that no id's rows need fit one task
    ordered = (data.repartitionByRange(n, F.col("doc_id"), F.substring("text", 1, 32))
               .sortWithinPartitions("doc_id", "text"))
    ordered.mapInArrow(build, SHARD_SCHEMA).write.parquet(path)


def _pack_docs(ids: list) -> bytes:
    nulls = np.array([x is None for x in ids], np.uint8)
    values = np.array([x or 0 for x in ids], "<i8")
    return struct.pack("<I", len(ids)) + nulls.tobytes() + values.tobytes()


def unpack_shard(body: bytes) -> tuple[list, WaveletMatrix, np.ndarray]:
    """Document ids, matrix and the documents' ends of a shard's bytes."""
    n, = struct.unpack_from("<I", body)
    nulls = np.frombuffer(body, np.uint8, n, 4)
    values = np.frombuffer(body, "<i8", n, 4 + n)
    matrix, ends = WaveletMatrix.from_bytes(body[4 + 9 * n:])
    return [None if z else int(v) for z, v in zip(nulls, values)], matrix, ends


def part_starts(shards: DataFrame) -> DataFrame:
    """``(part, before)``: ids in all partitions before each of the writing job.

    A row for each such partition, summed from the shards' counts without
    reading their bodies; a shard knows its place within its partition.
    """
    from pyspark.sql import Window

    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    return parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document, read from the
    shards' planes."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs, matrix, ends = unpack_shard(row["body"])
                ids = matrix.to_ids().astype("<u4")        # 32 bits only for the checksums
                ends = ends.astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(starts + row["shard_start"], pa.int64()),
                     pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = spark.read.parquet(path)
    # bounded: a row for each partition of the writing job, however many shards these hold
    before = F.broadcast(part_starts(shards))
    return (shards.select("part", "part_start", "body").join(before, "part")
            .select((F.col("before") + F.col("part_start")).alias("shard_start"), "body")
            .mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id",
                    text_col: str = "text", shard_tokens: int = 1 << 20) -> DataFrame:
    """Write the shards of all documents to the shared folder and read them back."""
    path = scratch_path(docs.sparkSession, "llm-wavelet")
    write_shards(docs, tokenizer_path, path, end_id, id_col, text_col, shard_tokens)
    return read_documents(docs.sparkSession, path)
