"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled good rows of the training folds; the
unlabelled set is drawn from all rows of those folds with labels unseen.  The
class prior is estimated by best-bin estimation: a first model ranks positives
against unlabelled text, and the prior is the smallest ratio of the unlabelled
to the positive share above a score, with a confidence margin, on all rows that
the first model has not seen: one histogram of scores over the corpus.  The scorer, a small network, then minimises the non-negative unbiased
risk: pi * R+(g) + max(0, Ru-(g) - pi * Rp-(g)), with the gradient turned
around in batches where the second term is negative.

The two samples that the networks are fitted on are bounded by ``sample_rows``
and drawn by the hash of the id; scoring is one pass over all rows that shuffles nothing.

Defined results: a NULL or empty text is scored by its features (zeros);
where no positive label exists every score is 0.5; repeated rows are scored
row by row; NULL labels and ids are not learned from; an input column with the
name of the score is replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tabsense.llm.common import text_blocks
from tabsense.llm.features import FEATURE_BYTES, NAMES, dense, list_array

SAMPLE_ROWS, HIDDEN, EPOCHS, THRESHOLD = 12_000, 16, 40, 0.7


class Model:
    """One hidden layer; ``score`` is the estimated probability of the positive class."""

    def __init__(self, mean, scale, w1, b1, w2, b2):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2 = mean, scale, w1, b1, w2, b2

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Minimise the non-negative risk for ``prior``; with None, plain positive-against-unlabelled logistic risk."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    m = Model(mean, scale, rng.normal(0, 1 / np.sqrt(both.shape[1]), (both.shape[1], hidden)), np.zeros(hidden), np.zeros(hidden), 0.0)
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    moments = [[np.zeros_like(np.asarray(v, float)), np.zeros_like(np.asarray(v, float))] for v in (m.w1, m.b1, m.w2, m.b2)]
    t, batches = 0, max(1, min(len(p), len(u)) // 128)
    sig = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    for epoch in range(epochs):
        pi, ui = (np.array_split(rng.permutation(len(x)), batches) for x in (p, u))
        for a, b in zip(pi, ui):
            x = np.concatenate([p[a], u[b]])
            is_p = np.arange(len(x)) < len(a)
            h = np.tanh(x @ m.w1 + m.b1)
            s = sig(h @ m.w2 + m.b2)
            up, un = is_p / len(a), ~is_p / len(b)
            soft = lambda g: np.logaddexp(0, g)
            g = h @ m.w2 + m.b2
            if prior is None:
                d = up * (s - 1) + un * s
            else:
                negative = (un * soft(g)).sum() - prior * (up * soft(g)).sum()
                d_negative = un * s - prior * up * s
                d = prior * up * (s - 1) + d_negative if negative >= 0 else -d_negative
            back = (d[:, None] * m.w2) * (1 - h * h)
            grads = (x.T @ back + 1e-4 * m.w1, back.sum(0), h.T @ d + 1e-4 * m.w2, d.sum())
            t += 1
            rate = 0.01 * (1 - 0.9 * epoch / epochs)
            for (name, grad), mo in zip(zip(("w1", "b1", "w2", "b2"), grads), moments):
                mo[0] = 0.9 * mo[0] + 0.1 * grad
                mo[1] = 0.999 * mo[1] + 0.001 * grad * grad
                step = rate * (mo[0] / (1 - 0.9 ** t)) / (np.sqrt(mo[1] / (1 - 0.999 ** t)) + 1e-8)
                setattr(m, name, getattr(m, name) - step)
    return m


def prior_of(positive_scores: np.ndarray, above, n: int, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Best-bin estimation of the positives' share among ``n`` unlabelled; ``above(cuts)`` counts those that score at least each cut."""
    p = np.sort(positive_scores)
    cuts = np.unique(p)
    qp = 1 - np.searchsorted(p, cuts, "left") / len(p)
    qu = above(cuts) / n
    margin = np.sqrt(np.log(4 / delta) / (2 * n)) + np.sqrt(np.log(4 / delta) / (2 * len(p)))
    best = np.argmin((qu + (1 + gamma) * margin) / qp)
    return float(np.clip(qu[best] / qp[best], 0.01, 0.99))


def estimate_prior(positive_scores: np.ndarray, unlabelled_scores: np.ndarray) -> float:
    """``prior_of`` for scores at hand."""
    u = np.sort(unlabelled_scores)
    return prior_of(positive_scores, lambda cuts: len(u) - np.searchsorted(u, cuts, "left"), len(u))


def _histogram_batches(batches, model, cuts) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(len(cuts.value) + 1, np.int64)
    for _, data, offsets in text_blocks(batches, limit=FEATURE_BYTES):
        place = np.searchsorted(cuts.value, model.value.score(dense(data, offsets)), "right")
        counts += np.bincount(place, minlength=len(counts))
    some = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(some, pa.int64()), pa.array(counts[some])], names=["place", "n"])


def corpus_prior(docs: DataFrame, model: Model, positive_scores: np.ndarray) -> float:
    """The positives' share among all rows of ``docs`` (text), from one histogram of their scores."""
    cuts = np.unique(positive_scores)
    context = docs.sparkSession.sparkContext
    shared, at = context.broadcast(model), context.broadcast(cuts)
    found = (docs.select("text").mapInArrow(lambda b: _histogram_batches(b, shared, at), "place long, n long")
             .groupBy("place").agg(F.sum("n").alias("n")).collect())  # one row per cut at most
    counts = np.zeros(len(cuts) + 1, np.int64)
    for r in found:
        counts[r["place"]] = r["n"]
    least = counts[::-1].cumsum()[::-1]  # rows that score at least the cut before
    return prior_of(positive_scores, lambda _: least[1:], max(int(counts.sum()), 1))


def feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_blocks(batches, limit=FEATURE_BYTES):
        yield pa.record_batch([rows.column(0), rows.column(1), list_array(dense(data, offsets))], names=["doc_id", "kind", "features"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Model | None, float]:
    """Learn from the rows of ``docs`` (doc_id, text) given: positives by ``labels`` (doc_id, good), and as many with labels unseen.
    An id that several rows have stands for one of them."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    good = (labels.where((F.col("good") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
            .join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sample_rows))
    web = docs.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(12)), "doc_id").limit(sample_rows)
    chosen = good.withColumn("kind", F.lit(1)).unionByName(web.withColumn("kind", F.lit(0))).toPandas()  # at most 2 * sample_rows ids
    # every other id of each kind is kept from the first model
    first = np.random.default_rng(3).permutation(len(chosen)) % 2 == 0
    picked = docs.sparkSession.createDataFrame([(int(i), int(k) * 2 + int(f)) for i, k, f in zip(chosen["doc_id"], chosen["kind"], first)], "doc_id long, kind int")
    rows = (docs.join(F.broadcast(picked), "doc_id").select("doc_id", "kind", "text")
            .mapInArrow(feature_batches, "doc_id long, kind int, features array<double>")
            .groupBy("doc_id", "kind").agg(F.min("features").alias("features")).toPandas().sort_values(["kind", "doc_id"]))
    x = np.stack(rows["features"].to_numpy()) if len(rows) else np.zeros((0, len(NAMES)))
    kind = rows["kind"].to_numpy()
    p, u = x[kind >= 2], x[kind < 2]
    if not len(p) or not len(u):
        return None, 0.5
    halves = [x[kind == k] if (kind == k).any() else whole for k, whole in ((3, p), (2, p), (1, u))]
    model = fit(halves[0], halves[2], None, epochs=15)
    seen = F.broadcast(picked.where("kind = 1").select("doc_id"))
    prior = corpus_prior(docs.join(seen, "doc_id", "left_anti"), model, model.score(halves[1]))
    return fit(p, u, prior), prior


def score_batches(batches: Iterator[pa.RecordBatch], model, into: str) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_blocks(batches, limit=FEATURE_BYTES):
        s = model.value.score(dense(data, offsets)) if model.value else np.full(rows.num_rows, 0.5)
        yield pa.record_batch([*(rows.column(i) for i in range(rows.num_columns)), pa.array(s)], names=[*rows.schema.names, into])


def score(docs: DataFrame, model: Model | None, into: str = "score") -> DataFrame:
    """All columns of ``docs``, which has a column text, and the score in column ``into``."""
    docs = docs.drop(into)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField(into, DoubleType())])
    return docs.mapInArrow(lambda b: score_batches(b, shared, into), schema)
