"""Quality scores by pairwise ranking (Bradley-Terry).

A preference pair holds a document labelled good and one labelled bad. The
chance that the first is preferred is the logistic function of the difference of
their scores, and a score is linear in a text's statistics, so learning is
logistic regression on differences, on a bounded sample. The threshold is the score
quantile at the bad documents' share, over all labelled documents that are not held
out; scores are mapped to 0..1 so that this quantile becomes the given decision level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gradewell.llm import textstats
from gradewell.llm.common import by_bytes, id_and_text, plain_texts, staged
from gradewell.llm.rules import labelled_sample, labelled_texts

#: Transformed statistics: small shares matter most near zero, so roots are used as well.
FEATURES = textstats.JUDGED + [f"root_{c}" for c in ("symbol_share", "bang_share", "upper_share", "dup_line_share")]


@dataclass(frozen=True)
class Ranker:
    weights: tuple              # of the features, in order
    threshold: float            # raw score at the quantile
    slope: float                # of the map to 0..1
    level: float                # what the threshold becomes

    def raw(self, features: list[Column]) -> Column:
        return sum((c * F.lit(w) for c, w in zip(features, self.weights)), F.lit(0.0))

    def score(self, raw: Column) -> Column:
        offset = math.log(self.level / (1 - self.level))
        x = (raw - F.lit(self.threshold)) * F.lit(self.slope) + F.lit(offset)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def own(name: str) -> str:
    """The name under which a statistic stands beside a table's own columns."""
    return f"__stat_{name}"


def feature_columns() -> list[Column]:
    return [F.col(own(c)) if not c.startswith("root_") else F.sqrt(F.col(own(c[5:]))) for c in FEATURES]


def with_statistics(docs: DataFrame, text_col: str) -> DataFrame:
    """The table with its texts' statistics as further columns, in one pass."""
    names = textstats.JUDGED

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text_col):
            rows = [textstats.counts(t, textstats.words_of(t)) for t in plain_texts(batch, text_col)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array([r[n] for r in rows], pa.float64()) for n in names)],
                [*batch.schema.names, *map(own, names)])

    schema = StructType(docs.schema.fields + [StructField(own(n), DoubleType()) for n in names])
    return docs.mapInArrow(measure, schema)


def fit_pairs(x: np.ndarray, good: np.ndarray, pairs: int = 50_000, ridge: float = 1e-3, seed: int = 11,
              level: float = 0.3, steps: int = 50) -> Ranker:
    """Weights from preference pairs drawn among the labelled rows, by Newton's
    method on the regularised logistic loss of feature differences."""
    width = x.shape[1]
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(up) or not len(down):
        # one kind of label only: no pair tells anything, every text is scored alike
        return Ranker((0.0,) * width, 0.0 if len(down) or not len(x) else -1.0, 1.0, level)
    scale = x.std(0)
    scale[scale == 0] = 1.0
    z = x / scale
    rng = np.random.default_rng(seed)
    d = z[rng.choice(up, pairs)] - z[rng.choice(down, pairs)]
    w = np.zeros(width)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(d @ w)))
        gradient = d.T @ (p - 1) / pairs + ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(width)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Ranker(tuple((w / scale).tolist()), *_threshold(x @ (w / scale), good), level)


def _threshold(scores: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """The score at the bad documents' share, and the slope of the map to 0..1."""
    ordered, cut = np.sort(scores), int((~good).sum())
    threshold = float(ordered[cut - 1] + ordered[cut]) / 2
    return threshold, float(3.0 / max(np.median(scores[good]) - threshold, 1e-6))


#: Precision of the quantiles: exact up to half as many scores, else within one in as many.
QUANTILES = 100_000


def over_all(ranker: Ranker, scores: DataFrame) -> Ranker:
    """The ranker with threshold and slope from all of ``scores (label, raw)``, by
    aggregation; as it is if labels of one kind are missing."""
    counts = scores.agg(F.count_if(F.col("label") == 0).alias("bad"), F.count_if(F.col("label") == 1).alias("good")).first()
    if not counts["bad"] or not counts["good"]:
        return ranker
    n = counts["bad"] + counts["good"]
    below, above = ((counts["bad"] + d) / n for d in (-0.5, 0.5))          # the places around the cut
    at = lambda share, of="raw": F.percentile_approx(of, share, QUANTILES)
    row = scores.where("label in (0, 1)").agg(
        at([below, above]).alias("cut"), at(0.5, F.when(F.col("label") == 1, F.col("raw"))).alias("middle")).first()
    threshold = sum(row["cut"]) / 2
    return replace(ranker, threshold=threshold, slope=3.0 / max(row["middle"] - threshold, 1e-6))


def held_out(doc_id: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int,
          level: float, sample: int) -> tuple[Ranker, DataFrame]:
    """Fit on at most ``sample`` labelled documents that are not held out, and set the
    threshold by all of them. Also ``(doc_id, raw)``, the raw scores of all rows."""
    open_labels = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
                   .where(~held_out(F.col("doc_id"), folds)))
    some = labelled_sample(open_labels, "doc_id", "label", sample)          # bounded by ``sample``
    rows = (with_statistics(labelled_texts(docs, some, id_col, text_col), "text")
            .select("doc_id", "label", *[c.alias(n) for c, n in zip(feature_columns(), FEATURES)])
            .toArrow().sort_by("doc_id"))
    x = np.column_stack([rows[n].to_numpy() for n in FEATURES]) if rows.num_rows else np.zeros((0, len(FEATURES)))
    ranker = fit_pairs(x, rows["label"].to_numpy() == 1, level=level)
    scored = with_statistics(id_and_text(docs, id_col, text_col), "text")
    raw = staged(scored.select("doc_id", ranker.raw(feature_columns()).alias("raw")), "raw-scores")
    known = open_labels.dropna().groupBy("doc_id").agg(F.min("label").alias("label"))
    return over_all(ranker, raw.join(known, "doc_id")), raw


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", folds: int = 5, level: float = 0.3,
                   sample: int = 20_000) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row.

    Rows whose crc32 of the id as text leaves 0 modulo ``folds`` are held out:
    their labels are never learned from. The weights come from at most ``sample`` of the
    other labelled documents (of texts with one id that of least hash), the threshold from
    all of them. Null and empty texts have all statistics 0 and are scored
    like any other; a null id is not held out and never labelled; repeated rows
    each come back, and count once in learning; without labels of both kinds every
    score is alike; an empty table gives an empty result; other columns are not read.
    """
    ranker, raw = learn(docs, labels, id_col, text_col, label_col, folds, level, sample)
    scored = raw.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), ranker.score(F.col("raw")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= F.lit(level)).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", folds: int = 5, level: float = 0.3,
                   sample: int = 20_000) -> DataFrame:
    """The rows scored at the decision level or above, with all their columns, in
    one pass without a shuffle of texts. Scores as in ``quality_scores``."""
    ranker, _ = learn(docs, labels, id_col, text_col, label_col, folds, level, sample)
    return (with_statistics(docs, text_col).where(ranker.score(ranker.raw(feature_columns())) >= F.lit(level))
            .select(docs.columns))
