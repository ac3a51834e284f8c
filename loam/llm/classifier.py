"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Per class, a mean and a covariance are fitted from sums that Spark adds up over all labelled rows
(no sample).  The covariance is shrunk towards the diagonal of the pooled one; its Cholesky factor is
inverted once and sent to the tasks, where a score is the logistic of the difference of the two
log-densities (Mahalanobis terms and log-determinants) and log-priors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .quality_rules import Stats

FEATURES = (
    "words", "word_length", "capitals", "symbols", "digits", "signs", "outside_ascii",
    "repeats", "stutter", "duplicate_lines", "distinct_words", "line_words",
)
SHRINKAGE = 0.1
#: A score from here on is predicted as label 1.
THRESHOLD = 0.7

_ALL = np.arange(256)
_DIGIT = (_ALL >= 0x30) & (_ALL <= 0x39)
_LETTER = ((_ALL | 32) >= 0x61) & ((_ALL | 32) <= 0x7A) & (_ALL < 0x80)
_SIGN = W.SPACED & (_ALL < 0x80) & ~_LETTER & ~_DIGIT


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text; fractions as square roots, sizes as logarithms."""
    s = Stats(column)
    n, chars = s.n_words, s.word_chars
    order = W.sort_within(s.w.doc, s.w.hash)
    d, h = s.w.doc[order], s.w.hash[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])[: len(d)]
    distinct = np.bincount(d[new], minlength=len(column))
    outside = s._sum(W.SPACED & (_ALL >= 0xC0))
    return np.column_stack([
        np.log1p(n), np.log1p(_ratio(chars, n)), np.sqrt(_ratio(s.n_capitals, chars)), np.sqrt(_ratio(s.n_symbols, chars)),
        np.sqrt(_ratio(s._sum(_DIGIT), chars)), np.sqrt(_ratio(s._sum(_SIGN), chars)), np.sqrt(_ratio(outside, chars)),
        np.sqrt(_ratio(s.n_repeat_words, n)), np.sqrt(_ratio(s.n_stutter, n)), np.sqrt(_ratio(s.n_dup_lines, s.n_lines)),
        np.log1p(distinct) - np.log1p(n), np.log1p(_ratio(n, s.n_lines)),
    ])


def add_statistics(docs: DataFrame, text: str = "text", to: str = "stats") -> DataFrame:
    """docs without its text, with an array of statistics; null and empty texts have those of no words."""
    keep = [c for c in docs.columns if c not in (text, to)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.chunks(batches, text):
            x = statistics(part.column(text))
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), rows], names=[*keep, to])

    return docs.select(*keep, text).mapInArrow(run, docs.select(keep).schema.add(to, T.ArrayType(T.DoubleType())))


@dataclass(frozen=True)
class Model:
    """For class 0 and 1: mean, inverse Cholesky factor, log-determinant of the covariance, log-prior."""

    mean: tuple[np.ndarray, np.ndarray]
    inverse: tuple[np.ndarray, np.ndarray]
    log_det: tuple[float, float]
    log_prior: tuple[float, float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        g = [-0.5 * (((x - self.mean[c]) @ self.inverse[c].T) ** 2).sum(1) - 0.5 * self.log_det[c] + self.log_prior[c] for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(g[0] - g[1], -700, 700)))


def fit(labelled: DataFrame, *, stats: str = "stats", label: str = "label", shrinkage: float = SHRINKAGE) -> Model:
    """The model of rows (stats, label 0 or 1); other labels and nulls are left out.

    Sums of the statistics and their products are added up by Spark; the driver gets one row for
    each pair of statistics and class, however many rows there are.  A class without rows gets the
    other's shape with a prior of half a row, so that a score is always defined.
    """
    m = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, m + 1, m + 1))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, m)
            x = np.column_stack([np.ones(len(x)), x])
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                total[c] += x[y == c].T @ x[y == c]
        c, i, j = (a.ravel() for a in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(i), pa.array(j), pa.array(total.ravel())], names=["c", "i", "j", "v"])

    rows = labelled.select(stats, F.col(label).cast("int")).where(F.col(label).isin(0, 1) & F.col(stats).isNotNull())
    sums = np.zeros((2, m + 1, m + 1))
    for r in rows.mapInArrow(run, "c long, i long, j long, v double").groupBy("c", "i", "j").agg(F.sum("v").alias("v")).collect():
        sums[r["c"], r["i"], r["j"]] = r["v"]
    n = sums[:, 0, 0]
    if n.sum() == 0:
        sums[:, 0, 0], n = 1, np.ones(2)
    for c in (0, 1):
        if n[c] == 0:
            sums[c] = sums[1 - c] * (0.5 / n[1 - c])
    n = sums[:, 0, 0]
    means = sums[:, 0, 1:] / n[:, None]
    cov = [sums[c, 1:, 1:] / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = np.diag(np.maximum(np.diag(n[0] * cov[0] + n[1] * cov[1]) / n.sum(), 1e-6))
    inverse, log_det = [], []
    for c in (0, 1):
        factor = np.linalg.cholesky((1 - shrinkage) * cov[c] + shrinkage * pooled)
        inverse.append(np.linalg.inv(factor))
        log_det.append(2 * float(np.log(np.diag(factor)).sum()))
    prior = np.log(n / n.sum())
    return Model(tuple(means), tuple(inverse), tuple(log_det), (float(prior[0]), float(prior[1])))


def score(df: DataFrame, model: Model, *, stats: str = "stats", threshold: float = THRESHOLD) -> DataFrame:
    """df, which has statistics, with score (0 to 1) and predicted (0 or 1) instead of them."""
    keep = [c for c in df.columns if c not in (stats, "score", "predicted")]
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = sent.value.scores(np.array(batch.column(stats).to_pylist(), float).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return df.select(*keep, stats).mapInArrow(run, df.select(keep).schema.add("score", "double").add("predicted", "integer"))


def score_texts(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs, texts included, with score and predicted; columns of these names are replaced."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.chunks(batches, text):
            s = sent.value.scores(statistics(part.column(text)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(keep).mapInArrow(run, docs.select(keep).schema.add("score", "double").add("predicted", "integer"))


def held_out(doc_id: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(stats: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", label: str = "quality", shrinkage: float = SHRINKAGE) -> Model:
    """The model of (doc_id, stats) and the labels of rows that aren't held out."""
    own = labels.select(doc_id, F.col(label).alias("label")).where(~held_out(doc_id))
    return fit(stats.select(doc_id, "stats").join(own, doc_id), shrinkage=shrinkage)
