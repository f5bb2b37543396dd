"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance shrunk towards the pooled diagonal; the score is the posterior of
label 1 from the difference of the log densities, whose Mahalanobis terms use Cholesky factors that are
computed once when the model is fitted.

Scale: fitting reads a bounded sample of the labelled rows (at most ``most`` of them, half of each class, by
a hash of doc_id), whose ids are the only table broadcast and whose statistics are all that reaches the driver:
``most`` rows of 30 numbers. Scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import bounded_batches
from ._text import trimmed
from ._features import SHARES, WIDTH, counts, transformed

#: At most so many labelled documents are used to fit, half of each class; their ids are broadcast (16 bytes each).
MOST_LABELLED = 20_000
CUT = 0.3


@dataclass
class Discriminant:
    """Fitted classes 0 and 1; without both classes in the labels, ``prior`` alone is the score."""

    prior: float
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    centre: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH))
    scale: np.ndarray = field(default_factory=lambda: np.ones(WIDTH))
    average: np.ndarray = field(default_factory=lambda: np.zeros(len(SHARES)))

    @staticmethod
    def fit(
        part: np.ndarray, whole: np.ndarray, sizes: np.ndarray, y: np.ndarray, prior: float | None = None, shrink: float = 0.1, lend: float = 10.0
    ) -> Discriminant:
        """``shrink``: weight of the diagonal target in each covariance; small classes shrink more, up to the target alone.

        The target is the class's own variances, with ``lend`` cases' worth of those within both classes. A class
        without rows leaves the prior alone, which is the share of label 1 unless it is given.
        """
        n1 = int((y == 1).sum())
        prior = (n1 + 1) / (len(y) + 2) if prior is None else prior
        if not n1 or n1 == len(y):
            return Discriminant(prior)
        average = part.sum(axis=0) / np.maximum(whole.sum(axis=0), 1)
        x = transformed(part, whole, sizes, average)
        centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        z = (x - centre) / scale
        means, factors = [], []
        classes = [z[y == label] for label in (0, 1)]
        pooled = sum(len(own) * own.var(axis=0) for own in classes) / len(z)
        for own in classes:
            mean = own.mean(axis=0)
            cov = (own - mean).T @ (own - mean) / len(own)
            a = max(shrink, min(1.0, z.shape[1] / len(own)))
            target = (len(own) * np.diag(cov) + lend * pooled) / (len(own) + lend)
            cov = (1 - a) * cov + a * np.diag(np.maximum(target, 0.05))
            means.append(mean)
            factors.append(np.linalg.cholesky(cov))
        return Discriminant(prior, np.array(means), np.array(factors), centre, scale, average)

    def scores(self, texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
        if self.means is None:
            return np.full(len(texts), self.prior)
        x = transformed(*counts(texts), self.average)
        z = (x - self.centre) / self.scale
        logs = []
        for mean, factor in zip(self.means, self.factors, strict=True):
            # forward substitution with the cached factor: |L^-1 (z - m)|^2 is the Mahalanobis distance
            d = np.zeros_like(z)
            r = z - mean
            for i in range(z.shape[1]):
                d[:, i] = (r[:, i] - d[:, :i] @ factor[i, :i]) / factor[i, i]
            logs.append(-0.5 * (d * d).sum(axis=1) - np.log(np.diag(factor)).sum())
        odds = logs[1] - logs[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may see; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def marks(labels: DataFrame) -> DataFrame:
    """doc_id, y of the labels that a fit may see: the highest quality of each document outside the held-out fifth."""
    own = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    return own.groupBy("doc_id").agg((F.max("quality") == 1).cast("int").alias("y"))


def labelled(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, text and y of at most ``most`` labelled documents, half of each class at most, chosen by a hash of doc_id."""
    own = marks(labels)
    parts = [own.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for y in (0, 1)]
    return docs.select("doc_id", "text").join(F.broadcast(parts[0].union(parts[1])), "doc_id").select("doc_id", "text", "y")


@trimmed
def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x = np.hstack(counts(b.column(1)))
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), rows], names=["doc_id", "y", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Discriminant:
    """Fit on a bounded sample of each class, with the prior of all labels; reruns give the same model.

    Of rows that repeat a doc_id, the least by its statistics counts. Labels of documents that are not there
    count for the prior alone.
    """
    bounded_batches(docs.sparkSession)
    own = labelled(docs, labels, most).mapInArrow(_statistics, "doc_id long, y int, x array<double>")
    rows = own.groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("s")).select("doc_id", "s.y", "s.x").toArrow()  # at most ``most``
    of_one, of_all = marks(labels).agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    y = np.asarray(rows.column("y").to_numpy(), dtype=np.int64)
    x = np.array(rows.column("x").to_pylist(), dtype=float).reshape(len(y), 2 * len(SHARES) + 2)
    order = np.lexsort((*x.T, y, rows.column("doc_id").to_numpy()))
    x, n = x[order], len(SHARES)
    return Discriminant.fit(x[:, :n], x[:, n : 2 * n], x[:, 2 * n :], y[order], (of_one + 1) / (of_all + 2))


def _scorer(model: Discriminant):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.scores(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def score_quality(docs: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null and empty texts get the score of a document without words, texts of any length are read whole, at
    some 60 bytes of arrays a byte. Repeated rows get the same score; a null doc_id is kept. Without usable
    labels of both classes every score is the smoothed share of label 1. An empty table gives an empty
    result; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = own.mapInArrow(_scorer(model), "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def _keeper(model: Discriminant):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.scores(b.column("text")) >= CUT))

    return run


def keep_good(docs: DataFrame, model: Discriminant) -> DataFrame:
    """The documents that the classifier accepts, with all their columns; nulls, long and repeated texts as in score_quality."""
    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(_keeper(model), docs.schema)
