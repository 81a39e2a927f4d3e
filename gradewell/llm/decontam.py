"""Benchmark decontamination with suffix arrays over the training texts.

Each task builds, for a shard of some megabytes of documents, the array of all
suffixes that begin with a word of the benchmark (no other suffix can match one
of its windows), sorted by their words. Every suffix of the test items is then
found by binary search, which gives its range in the array and so all places
where its first words stand; the match is extended word by word to its longest.
Documents are read once and never shuffled. The test items, a stated query set,
go to the tasks in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import by_bytes, id_and_text, plain_texts

SCHEMA = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, "
          "contaminated boolean, longest_match long, hit_spans array<struct<first:long,end:long>>")

# A-Z are lowered; digits, letters and all bytes of other characters make words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32
                    for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class TestBlock:
    """The windows of a block of test items, as suffixes to search for."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items, tokens, starts, needs, owners = [], [], [], [], []
        number = self.vocabulary
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            at = len(tokens)
            tokens += [number.setdefault(w, len(number) + 1) for w in words]
            tokens.append(0)
            need = min(window, len(words))
            for i in range(len(words) - need + 1):
                starts.append(at + i)
                needs.append(need)
                owners.append(len(self.items))
            self.items.append(item_id)
        self.bits = max(1, (len(number) + 1).bit_length())
        self.per = max(1, 63 // self.bits)                # words in one sort key
        self.levels = -(-window // self.per)              # keys that cover a window
        depth = self.per * self.levels
        self.tokens = np.array(tokens + [0] * (depth + 1), np.int64)
        # a window that several items share is searched for once
        padded = np.zeros((len(starts), depth), np.int64)
        for i, (s, need) in enumerate(zip(starts, needs)):
            padded[i, :need] = self.tokens[s:s + need]
        self.windows, which = np.unique(padded, axis=0, return_inverse=True)
        which = which.reshape(-1)
        self.needs = (self.windows > 0).sum(1)
        self.owners: list[list[int]] = [[] for _ in self.windows]
        for i, w in enumerate(which):
            self.owners[w].append(owners[i])
        # all places of a window, one window's after another's
        self.places = np.array(starts, np.int64)[np.argsort(which, kind="stable")]
        self.n_places = np.bincount(which, minlength=len(self.windows))
        self.first = np.cumsum(self.n_places) - self.n_places
        top = (1 << self.bits) - 1
        high = np.where(self.windows > 0, self.windows, top)
        self.low_keys, self.high_keys = self._keys(self.windows), self._keys(high)

    def _keys(self, windows: np.ndarray) -> list[np.ndarray]:
        out = []
        for level in range(self.levels):
            key = np.zeros(len(windows), np.int64)
            for j in range(self.per):
                key = key << self.bits | windows[:, level * self.per + j]
            out.append(key)
        return out


def suffix_array(tokens: np.ndarray, block: TestBlock) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the suffixes that begin with a known word, sorted by their first
    words, and their sort keys in that order. ``tokens`` ends with zeros."""
    n = len(tokens) - block.per * block.levels
    key = np.zeros(n + block.per * (block.levels - 1), np.int64)
    for j in range(block.per):
        key = key << block.bits | tokens[j:j + len(key)]
    places = np.flatnonzero(tokens[:n] > 0)
    keys = [key[places + level * block.per] for level in range(block.levels)]
    order = np.lexsort(keys[::-1])
    return places[order], [k[order] for k in keys]


def lower_bounds(keys: list[np.ndarray], wanted: list[np.ndarray], after_equal: bool) -> np.ndarray:
    """Binary search of all wanted keys at once: the first place in the array not
    less than each (or, ``after_equal``, greater)."""
    lo = np.zeros(len(wanted[0]), np.int64)
    hi = np.full(len(wanted[0]), len(keys[0]), np.int64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        at = np.minimum(mid, len(keys[0]) - 1)
        less, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for k, w in zip(keys, wanted):
            here = k[at]
            less |= same & (here < w)
            same &= here == w
        if after_equal:
            less |= same
        lo = np.where(open_ & less, mid + 1, lo)
        hi = np.where(open_ & ~less, mid, hi)
    return lo


def find(texts: list[list[bytes]], block: TestBlock):
    """For one shard: start of each document among the words, a flag for each word
    that is hit, pairs of (document, item), and each document's longest match."""
    get = block.vocabulary.get
    depth = block.per * block.levels
    ends = np.cumsum([len(w) + 1 for w in texts])          # a zero after each document
    starts = ends - np.array([len(w) + 1 for w in texts])
    tokens = np.zeros(int(ends[-1]) + depth + 1, np.int64)
    for s, words in zip(starts, texts):
        tokens[s:s + len(words)] = [get(w, 0) for w in words]
    places, keys = suffix_array(tokens[:int(ends[-1]) + depth], block)
    marks = np.zeros(len(tokens) + 1, np.int32)
    longest = np.zeros(len(texts), np.int64)
    if not len(places) or not len(block.windows):
        return starts, marks[:-1] > 0, np.zeros((0, 2), np.int64), longest
    lo = lower_bounds(keys, block.low_keys, False)
    hi = lower_bounds(keys, block.high_keys, True)
    found = np.flatnonzero(hi > lo)
    sizes = (hi - lo)[found]
    which = np.repeat(found, sizes)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = places[np.repeat(lo[found], sizes) + inner]
    need = block.needs[which]
    np.add.at(marks, at, 1)
    np.add.at(marks, at + need, -1)
    docs = np.searchsorted(ends, at, side="right")
    # longest verbatim match: from each place of the window, go on while the next words agree
    for nth in range(int(block.n_places[which].max(initial=0))):
        some = np.flatnonzero(block.n_places[which] > nth)
        here, test, length = at[some], block.places[block.first[which[some]] + nth], need[some]
        going = np.arange(len(some))
        while len(going):
            a, b = tokens[here[going] + length[going]], block.tokens[test[going] + length[going]]
            going = going[(a == b) & (a > 0)]
            length[going] += 1
        np.maximum.at(longest, docs[some], length)
    pairs = np.unique(np.column_stack([docs, which]), axis=0)
    return starts, np.cumsum(marks[:-1]) > 0, pairs, longest


def runs(flags: np.ndarray) -> list[dict]:
    """The stretches of set flags, ends exclusive."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"first": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]


def test_blocks(spark, items: DataFrame, window: int, block_bytes: int, id_col: str, text_col: str) -> list:
    """Broadcast blocks of test items, each of about ``block_bytes`` of text."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    out = []
    for i in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else rows
        block = sorted((r["item_id"], r["text"]) for r in part.toLocalIterator())
        out.append(spark.sparkContext.broadcast(block))
    return out


def searcher(blocks: list, window: int):
    """A function that gives, for each text of a shard, its number of words, a flag
    for each word that is hit, the items found and the longest match."""
    kept = TestBlock(blocks[0].value, window) if len(blocks) == 1 else None

    def search(shard: list[str]) -> list[tuple[int, np.ndarray, set, int]]:
        texts = [words_of(t) for t in shard]
        hit = longest = starts = None
        names: list[set] = [set() for _ in texts]
        for b in blocks:
            block = kept or TestBlock(b.value, window)
            starts, marks, pairs, far = find(texts, block)
            hit = marks if hit is None else hit | marks
            longest = far if longest is None else np.maximum(longest, far)
            for d, w in pairs:
                names[d].update(block.items[o] for o in block.owners[w])
        return [(len(words), hit[s:s + len(words)], names[i], int(longest[i]))
                for i, (s, words) in enumerate(zip(starts, texts))]

    return search


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id",
                  text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                  shard_bytes: int = 6 << 20, block_bytes: int = 16 << 20) -> DataFrame:
    """Words of each row that stand inside an occurrence of a test window.

    A window is ``window`` consecutive words of an item; an item with fewer, but
    not none, is one window. Null and empty texts have no words and are clean; a
    null document id stays null; a null item id counts as the empty string;
    repeated documents each come back, repeated items count once; empty tables
    give clean or empty results; other columns are not read.
    """
    blocks = test_blocks(docs.sparkSession, items, window, block_bytes, item_id, item_text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = searcher(blocks, window)
        for batch in by_bytes(batches, limit=shard_bytes):
            rows = []
            for n_words, hit, names, far in search(batch.column("text").to_pylist()):
                n_hit = int(np.count_nonzero(hit))
                ids = ",".join(sorted(names))
                rows.append((n_words, n_hit, len(names), hashlib.sha256(ids.encode()).hexdigest(),
                             n_hit > 0, far, runs(hit) if n_hit else []))
            span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), span)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))],
                [c.split()[0] for c in SCHEMA.split(", ")])

    return id_and_text(docs, id_col, text_col).mapInArrow(scan, SCHEMA)


def clean_documents(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text",
                    item_id: str = "item_id", item_text: str = "text", shard_bytes: int = 6 << 20,
                    block_bytes: int = 16 << 20) -> DataFrame:
    """The rows without a hit word, with all their columns, in one pass over the
    table; hits as in ``contamination``."""
    blocks = test_blocks(docs.sparkSession, items, window, block_bytes, item_id, item_text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = searcher(blocks, window)
        for batch in by_bytes(batches, text_col, shard_bytes):
            yield batch.filter(pa.array([not hit.any() for _, hit, _, _ in search(plain_texts(batch, text_col))],
                                        pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
