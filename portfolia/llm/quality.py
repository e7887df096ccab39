"""Document quality by regularised quadratic discriminant analysis.

Each text becomes a row of transformed statistics (logs of sizes, log-odds of shares). Both classes get a
mean and a covariance, shrunk towards the pooled one and towards its own mean variance. A document's score
is the logistic of the difference of the two Mahalanobis log-densities, taken per statistic so that it does
not saturate; the Cholesky factors are computed once and sent with the model.

Moments are summed over all labelled rows outside the held-out part: per task first, then by Spark, so the
driver gets one row per class and moment. Rows: null text counts as empty; an empty text has defined
statistics and a score; repeated rows are scored alike; a null id is a row that no label meets. Without both
classes among the labels every score is the share of label 1 (0.5 without labels). Other columns are unread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portfolia.llm import common

CLASS_SHRINKAGE, RIDGE = 0.15, 0.05

_KINDS = np.zeros((256, 7))
for _k, _members in enumerate((
        range(97, 123), range(65, 91), range(48, 58), [32, 9, 13], [10], map(ord, ".,;:?'\"()-"), range(128, 256))):
    _KINDS[list(_members), _k] = 1

NAMES = ["log_bytes", "log_words", "word_length", "upper", "digit", "space", "line_break", "punctuation", "symbol",
         "high_byte", "distinct_words", "distinct_pairs", "same_neighbours", "distinct_lines", "words_per_line"]


def _odds(part: float, whole: float) -> float:
    return math.log((part + 0.5) / (whole - part + 0.5))


def statistics(text: str) -> list[float]:
    """The transformed statistics of one whole text, in the order of ``NAMES``."""
    raw = text.encode()
    lower, upper, digit, space, breaks, point, high = (
        np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KINDS).tolist()
    size, words = len(raw), text.split()
    n = len(words)
    letters = lower + upper
    symbol = size - letters - digit - space - breaks - point - high
    lines = [x for x in text.split("\n") if x]
    return [
        math.log1p(size), math.log1p(n), math.log1p((size - space - breaks) / max(n, 1)),
        _odds(upper, letters), _odds(digit, size), _odds(space, size), _odds(breaks, size), _odds(point, size),
        _odds(symbol, size), _odds(high, size), _odds(len(set(words)), n),
        _odds(len(set(zip(words, words[1:], strict=False))), max(n - 1, 0)),
        _odds(sum(map(eq, words, words[1:])), n), _odds(len(set(lines)), len(lines)),
        math.log1p(n / max(len(lines), 1))]


def with_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and statistics of every row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [statistics(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values, pa.list_(pa.float64()))], names=[id_col, "statistics"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, statistics array<double>")


class Model(NamedTuple):
    """Means, inverse Cholesky factors, log-determinants and the log-odds of the classes 0 and 1."""

    means: list
    factors: list
    log_dets: list
    prior: float
    share: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.share)
        density = [-0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d
                   for m, f, d in zip(self.means, self.factors, self.log_dets, strict=True)]
        margin = (density[1] - density[0] + self.prior) / x.shape[1]
        return 1 / (1 + np.exp(-np.clip(margin, -700, 700)))


def fit(labelled: DataFrame, label: str = "label") -> Model:
    """Fit from all rows of ``statistics`` and a 0/1 label; other labels and nulls are left out."""
    d = len(NAMES)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(y), d)
            for k in (0, 1):
                own = x[y == k]
                total[k, 0] += len(own)
                total[k, 1 : 1 + d] += own.sum(axis=0)
                total[k, 1 + d :] += (own.T @ own).ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["k", "m"])

    rows = labelled.where(F.col(label).isin(0, 1)).select("statistics", F.col(label).cast("int"))
    sums = (rows.mapInArrow(moments, "k int, m array<double>")
            .select("k", F.posexplode("m").alias("at", "v")).groupBy("k", "at").agg(F.sum("v").alias("v")).collect())
    total = np.zeros((2, 1 + d + d * d))
    for r in sums:
        total[r["k"], r["at"]] = r["v"]
    n = total[:, 0]
    if n.min() < 2:
        return Model([], [], [], 0.0, float(n[1] / n.sum()) if n.sum() else 0.5)
    means = [total[k, 1 : 1 + d] / n[k] for k in (0, 1)]
    own = [total[k, 1 + d :].reshape(d, d) / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    factors, log_dets = [], []
    for k in (0, 1):
        s = (1 - CLASS_SHRINKAGE) * own[k] + CLASS_SHRINKAGE * pooled
        s = (1 - RIDGE) * s + RIDGE * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
        lower = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(lower))
        log_dets.append(2 * float(np.log(np.diag(lower)).sum()))
    return Model(means, factors, log_dets, math.log(n[1] / n[0]), float(n[1] / n.sum()))


def score(df: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """Id, score and predicted class of rows with ``statistics``."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(NAMES))
            s = sent.value.scores(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                names=[id_col, "score", "predicted"])

    return df.select(id_col, "statistics").mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def training_rows(labels: DataFrame, label: str, keep: Column, id_col: str = "doc_id") -> DataFrame:
    """One label per id: ids with a null, or with labels that differ, are left out."""
    return (labels.where(keep & F.col(id_col).isNotNull()).groupBy(id_col)
            .agg(F.min(label).alias("label"), F.max(label).alias("most")).where(F.col("label") == F.col("most"))
            .drop("most"))


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that a model learnt from them predicts to be of label 1."""
    rows = training_rows(labels, label, common.remainder(id_col, folds) != held, id_col)
    model = fit(with_statistics(docs, id_col, text_col).join(rows, id_col))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep():
        def accepts(texts: list[str]) -> np.ndarray:
            if not texts:
                return np.zeros(0, bool)
            return sent.value.scores(np.array([statistics(t) for t in texts])) >= 0.5
        return accepts

    return common.rows_where(docs, text_col, keep)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every document; rows whose crc32 remainder is ``held`` lend no label."""
    table = common.stored(with_statistics(docs, id_col, text_col), "quality")
    rows = training_rows(labels, label, common.remainder(id_col, folds) != held, id_col)
    model = fit(table.join(rows, id_col))
    return score(table, model, id_col).select(
        id_col, (common.remainder(id_col, folds) == held).alias("held_out"), "score", "predicted")
