"""Document quality by a regularised quadratic discriminant.

Each class has a normal density over transformed counts of the text. Its covariance
is shrunk towards the pooled one, and that towards its diagonal; the score is the
logistic of the log-density difference, from Mahalanobis distances by the Cholesky
factors kept with the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.llm.labels import held_out, quality_labels
from faultline.llm.shared import slices
from faultline.llm.statistics import COUNTS, counts, with_counts
from faultline.session import cut

POOLED = 0.3
DIAGONAL = 0.1
CUTOFF = 0.7


def features(table: np.ndarray) -> np.ndarray:
    """Transformed counts: square roots of rates and logarithms of lengths, one row per text."""
    c = {name: table[:, i].astype(float) for i, name in enumerate(COUNTS)}
    n, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.column_stack(
        [
            np.sqrt(c["n_symbols"] / chars),
            np.sqrt(c["n_bangs"] / n),
            np.sqrt(c["n_capitals"] / chars),
            np.sqrt(c["n_digits"] / chars),
            c["n_repeat_words"] / n,
            c["n_dup_lines"] / lines,
            np.log1p(c["n_distinct"]) - np.log1p(c["n_words"]),
            np.log1p(c["n_stops"]) - np.log1p(c["n_words"]),
            np.log1p(c["word_chars"] / n),
            np.log1p(c["n_words"]),
        ]
    )


WIDTH = features(np.zeros((1, len(COUNTS)), np.int64)).shape[1]


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors, log determinants and the log odds of the classes."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]
    odds: float

    def score(self, table: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of ``COUNTS``; the prior's where a class had no rows."""
        if not len(table):
            return np.zeros(0)
        gain = np.full(len(table), self.odds)
        if self.means:
            x = features(table)
            density = [
                -0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - o
                for m, f, o in zip(self.means, self.factors, self.offsets)
            ]
            gain = gain + density[1] - density[0]
        return 1.0 / (1.0 + np.exp(-np.clip(gain, -500, 500)))


def fit(train: DataFrame, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant:
    """The discriminant of rows with ``COUNTS`` and a ``quality`` of 0 or 1.

    Every task sends the moments of its rows; only their sums reach the driver.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + WIDTH, 1 + WIDTH))
        for piece in slices(batches, 8192):
            label = piece.column("quality").to_numpy()
            x = features(np.column_stack([piece.column(c).to_numpy() for c in COUNTS]))
            x = np.column_stack([np.ones(len(x)), x])
            for quality in (0, 1):
                part = x[label == quality]
                sums[quality] += part.T @ part
        at = np.arange(sums.size)
        yield pa.record_batch([pa.array(at), pa.array(sums.ravel())], names=["at", "value"])

    rows = train.select("quality", *COUNTS).mapInArrow(moments, "at bigint, value double")
    total = np.zeros(2 * (1 + WIDTH) ** 2)
    for r in rows.groupBy("at").agg(F.sum("value").alias("value")).collect():
        total[r["at"]] = r["value"]
    total = total.reshape(2, 1 + WIDTH, 1 + WIDTH)
    n = total[:, 0, 0]
    odds = float(np.log((n[1] + 1) / (n[0] + 1)))
    if n.min() < 2:
        return Discriminant([], [], [], odds)
    means = [total[c, 0, 1:] / n[c] for c in (0, 1)]
    spread = [total[c, 1:, 1:] / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    shared = (n[0] * spread[0] + n[1] * spread[1]) / n.sum()
    factors, offsets = [], []
    for own in spread:
        mixed = (1 - pooled) * own + pooled * shared
        mixed = (1 - diagonal) * mixed + diagonal * np.diag(np.diag(shared)) + 1e-6 * np.eye(WIDTH)
        lower = np.linalg.cholesky(mixed)
        factors.append(np.linalg.inv(lower))
        offsets.append(float(np.log(np.diag(lower)).sum()))
    return Discriminant(means, factors, offsets, odds)


def fit_on_labels(spark: SparkSession, sf_dir: str, counted: DataFrame) -> Discriminant:
    """Fit on the labelled rows of a table of doc_id and ``COUNTS``, without the held-out quarter."""
    return fit(counted.where(~held_out()).join(quality_labels(spark, sf_dir), "doc_id"))


def score_counts(counted: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and score of every row of doc_id and ``COUNTS``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 8192):
            table = np.column_stack([piece.column(c).to_numpy() for c in COUNTS])
            yield pa.record_batch([piece.column("doc_id"), pa.array(model.score(table))], names=["doc_id", "score"])

    kind = dict(counted.dtypes)["doc_id"]
    return counted.select("doc_id", *COUNTS).mapInArrow(score, f"doc_id {kind}, score double")


def score_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and score of every row of ``docs``.

    Null texts and texts without words have counts of 0 and are scored by them;
    repeated rows score alike; an empty table gives no rows. Rows without an id or
    label are scored but not learnt from.
    """
    counted = cut(with_counts(docs, ["doc_id"]))
    return score_counts(counted, fit_on_labels(spark, sf_dir, counted))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that score ``cutoff`` or more, unchanged.

    Texts are counted twice, for the fit and for the filter, rather than shuffled.
    """
    model = fit_on_labels(spark, sf_dir, cut(with_counts(docs, ["doc_id"])))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            table = np.array([counts(t) for t in piece.column("text").to_pylist()], np.int64)
            good = model.score(table.reshape(-1, len(COUNTS))) >= cutoff
            yield piece.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
