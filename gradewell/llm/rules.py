"""Quality rules: an ordered decision list of threshold conjunctions, learned by
sequential covering from labelled statistics and given out as one Spark
conditional expression.

A rule is grown on two thirds of the examples not yet covered, a condition at a
time by information gain, then pruned on the other third from its last condition
back. A rule that is not precise enough on the pruning part ends the list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.llm import textstats
from gradewell.llm.common import by_bytes, id_and_text, staged, text_hash

STATS = (["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], textstats.JUDGED)
STATS_SCHEMA = "doc_id long, " + ", ".join(
    [f"{c} long" for c in STATS[0]] + [f"{c} double" for c in textstats.JUDGED])
LEARNED = textstats.JUDGED + ["repeat_share"]


@dataclass(frozen=True)
class Condition:
    column: str
    above: bool                 # value >= threshold, else value <= threshold
    threshold: float

    def holds(self, values: dict) -> np.ndarray:
        x = values[self.column]
        return x >= self.threshold if self.above else x <= self.threshold

    def expression(self) -> Column:
        c, t = F.col(self.column), F.lit(float(self.threshold))
        return c >= t if self.above else c <= t

    def __str__(self) -> str:
        return f"{self.column} {'>=' if self.above else '<='} {self.threshold:.6g}"


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exact counts and shares of each whole text; a null text has no words."""
    names = STATS[0] + STATS[1]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                words = textstats.words_of(text)
                row = textstats.counts(text, words)
                row["n_repeat_words"] = textstats.repeated_words(words)
                rows.append(row)
            columns = [pa.array([r[n] for r in rows], pa.int64() if n in STATS[0] else pa.float64())
                       for n in names]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    return id_and_text(docs, id_col, text_col).mapInArrow(measure, STATS_SCHEMA)


def _gain(p0: int, n0: int, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Information gained about the covered positives by a further condition."""
    with np.errstate(divide="ignore", invalid="ignore"):
        g = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.where(p > 0, g, -np.inf)


def _grow(values: dict, bad: np.ndarray, columns: list[str]) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while True:
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p0 or not n0:
            break
        best = (1e-9, None)
        for column in columns:
            x, y = values[column][inside], bad[inside]
            order = np.argsort(x, kind="stable")
            x, y = x[order], y[order]
            p, n = np.cumsum(y), np.cumsum(~y)
            cut = np.flatnonzero(x[1:] > x[:-1])            # between two different values
            if not len(cut):
                continue
            middle = (x[cut] + x[cut + 1]) / 2
            for above, g in ((False, _gain(p0, n0, p[cut], n[cut])),
                             (True, _gain(p0, n0, p0 - p[cut], n0 - n[cut]))):
                i = int(np.argmax(g))
                if g[i] > best[0]:
                    best = (g[i], Condition(column, above, float(middle[i])))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(values)
    return rule


def _covered(rule: list[Condition], values: dict, size: int) -> np.ndarray:
    out = np.ones(size, bool)
    for condition in rule:
        out &= condition.holds(values)
    return out


def learn_list(values: dict[str, np.ndarray], bad: np.ndarray, columns: list[str], seed: int = 7,
               precision: float = 0.9, least: int = 2) -> list[list[Condition]]:
    """Rules that mark ``bad`` examples, in order; whatever none covers is good.

    Columns are taken in the given order, so ties have one outcome. A rule takes
    conditions as long as they gain, and the list rules as long as they are precise:
    each takes some examples out, so both end.
    """
    rng = np.random.default_rng(seed)
    rest, rules = np.arange(len(bad)), []
    while bad[rest].any():
        shuffled = rng.permutation(rest)
        grow, prune = np.sort(shuffled[: -(-2 * len(rest) // 3)]), np.sort(shuffled[-(-2 * len(rest) // 3):])
        part = lambda rows: {c: values[c][rows] for c in columns}
        rule = _grow(part(grow), bad[grow], columns)
        if not rule:
            break

        def worth(r):
            inside = _covered(r, part(prune), len(prune))
            p, n = int((inside & bad[prune]).sum()), int((inside & ~bad[prune]).sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        inside = _covered(rule, part(rest), len(rest))
        hits = int((inside & bad[rest]).sum())
        if hits < least or hits < precision * inside.sum() or worth(rule) < 2 * precision - 1 and len(prune) > 20:
            break
        rules.append(rule)
        rest = rest[~inside]
    return rules


def as_expression(rules: list[list[Condition]]) -> Column:
    """The list as one ordered conditional: false where a rule holds, else true."""
    out = F.lit(True)
    for rule in reversed(rules):
        holds = F.lit(True)
        for condition in rule:
            holds = holds & condition.expression()
        out = F.when(holds, F.lit(False)).otherwise(out)
    return out


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """At most ``most`` labelled ids, chosen by a hash of the id: ``(doc_id, label)``.

    Rows without id or label are left out; an id with several labels counts once,
    with its least label.
    """
    rows = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
            .dropna().groupBy("doc_id").agg(F.min("label").alias("label")))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, label, text)`` of the ids in ``labels (doc_id, label)``, at most 20,000 or
    as many as the caller's sample allows; of texts with the same id that of least hash,
    so that what is learned does not depend on the table's layout."""
    found = id_and_text(docs, id_col, text_col).join(F.broadcast(labels), "doc_id")
    least = F.struct(*text_hash(F.col("text")), "text")
    return found.groupBy("doc_id", "label").agg(F.min(least).alias("t")).select("doc_id", "label", "t.text")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", sample: int = 20_000) -> DataFrame:
    """Counts, base verdict and learned verdict of each row.

    ``base_failed``: fewer than 10 words, or more than a fifth of the words in
    repeated windows of five. ``kept``: false for those, else the decision
    list's verdict, learned from at most ``sample`` labelled documents (of texts with one
    id from that of least hash). Null and
    empty texts have no words and fail; repeated rows each come back; a null id
    stays null and is never labelled; without labels, or with an empty table,
    the list is empty and only the base decides. Other columns are not read.
    """
    share = F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1))
    stats = statistics(docs, id_col, text_col).withColumn("repeat_share", share)
    some = staged(labelled_sample(labels, id_col, label_col, sample), "labelled")          # bounded by ``sample``
    texts = labelled_texts(docs, some, id_col, text_col)
    rows = (statistics(texts, "doc_id", "text").withColumn("repeat_share", share).join(F.broadcast(some), "doc_id")
            .select("doc_id", "label", *LEARNED).toArrow().sort_by("doc_id"))
    values = {c: rows[c].to_numpy() for c in LEARNED}
    rules = learn_list(values, rows["label"].to_numpy() == 0, LEARNED) if rows.num_rows else []
    failed = ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return (stats.select("doc_id", *STATS[0], failed.alias("base_failed"),
                         (~failed & as_expression(rules)).alias("kept")))
