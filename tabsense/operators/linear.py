"""Linear and ridge regression with cross-validation from one Gram matrix per fold.

With z = (1, x, y), shifted by the columns' means, the sum of z z^T over a fold
is all that a least-squares fit and its error need.  One pass sums it for every
fold; the model on all rows uses the total, the model without a fold the total
less that fold's, and a fold's squared error is the quadratic form of its own
matrix: nothing is fitted twice and no row is read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.functions.columns import q
from tabsense.session import worker_path


@dataclass
class LinearModel:
    inputs: list
    coefficients: np.ndarray
    intercept: float

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` (with the inputs) and its ``prediction``."""
        value = F.lit(float(self.intercept))
        for c, w in zip(self.inputs, self.coefficients):
            value = value + F.lit(float(w)) * q(c)
        return df.withColumn("prediction", value)

    def importances(self) -> None:
        return None


def _gram_batches(batches, shift: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per fold and row of its matrix: what one task adds to it."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        fold = batch.column(0).to_numpy()
        z = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], 1) - shift
        z = np.concatenate([np.ones((len(z), 1)), z], 1)
        for f in np.unique(fold).tolist():
            part = z[fold == f]
            held[f] = held.get(f, 0) + part.T @ part
    folds = [f for f in held for _ in held[f]]
    lines = [line for f in held for line in held[f]]
    yield pa.record_batch([pa.array(folds, pa.int32()), pa.array([i for f in held for i in range(len(held[f]))], pa.int32()),
                           pa.array(lines, pa.list_(pa.float64()))], names=["fold", "line", "sums"])


def grams(train: DataFrame, inputs: list[str], folds: int) -> tuple[np.ndarray, np.ndarray]:
    """(fold, inputs + 2, inputs + 2) sums of z z^T, and the means that shift z."""
    worker_path(train.sparkSession)
    columns = [*inputs, "label"]
    means = train.agg(*[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    shift = np.array([m or 0.0 for m in means], np.float64)
    plain = train.select(F.col("fold").cast("int").alias("fold"), *[q(c).cast("double") for c in columns])
    parts = plain.mapInArrow(lambda b: _gram_batches(b, shift), "fold int, line int, sums array<double>")
    added = (parts.select("fold", "line", F.posexplode("sums").alias("place", "value"))
             .groupBy("fold", "line", "place").agg(F.sum("value").alias("value")))
    out = np.zeros((folds, len(columns) + 1, len(columns) + 1))
    for r in added.collect():  # folds * (inputs + 2) ** 2 numbers
        out[r["fold"], r["line"], r["place"]] = r["value"]
    return out, shift


def solve(gram: np.ndarray, alpha: float) -> np.ndarray:
    """(1, -w0, -w) turned so that its product with z = (1, x, y) is the error y - w0 - w x, in shifted columns."""
    n = gram[0, 0]
    x, y = gram[0, 1:-1] / n, gram[0, -1] / n
    inner = gram[1:-1, 1:-1] - n * np.outer(x, x)
    target = gram[1:-1, -1] - n * x * y
    scale = np.sqrt(np.maximum(np.diag(inner), 0))
    scale[scale == 0] = 1
    if alpha:
        w = np.linalg.solve(inner + alpha * np.eye(len(inner)), target)
    else:  # the least coefficients, in units of the columns, where columns depend on each other
        w = np.linalg.pinv(inner / np.outer(scale, scale), rcond=1e-12, hermitian=True) @ (target / scale) / scale
    return np.concatenate([[-(y - w @ x)], -w, [1.0]])


def r2(gram: np.ndarray, error: np.ndarray) -> float | None:
    """Of the rows in ``gram``; None where the target does not vary."""
    total = gram[-1, -1] - gram[0, -1] ** 2 / gram[0, 0]
    return float(1 - error @ gram @ error / total) if total > 0 else None


def fit(gram: np.ndarray, shift: np.ndarray, inputs: list[str], alpha: float) -> tuple[LinearModel, list[float | None]]:
    """The model on all rows, and each fold's r2 by the model on the others."""
    total = gram.sum(0)
    error = solve(total, alpha)
    w = -error[1:-1]
    model = LinearModel(list(inputs), w, float(-error[0] + shift[-1] - w @ shift[:-1]))
    folds = [r2(g, solve(total - g, alpha)) if 0 < g[0, 0] < total[0, 0] else None for g in gram]
    return model, folds
