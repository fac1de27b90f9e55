"""Pairwise-complete co-moments of all pairs of numeric columns by blocks of columns.

For a batch of rows, with X its values shifted by a value of each column and M
which of them are present, four matrix products hold every pair's sums: M'M
counts, X'M and (X^2)'M the sums of one column where the other is present, X'X
the products.  A task adds up its batches and gives one row per column; the
tasks' rows are added by column.  Work and shuffle do not grow with a record
per row and pair; columns go in strips, so that a task holds at most
``STRIP_CELLS`` numbers of a kind.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.functions.columns import q
from tabsense.session import worker_path

#: Cells of one of the four matrices in a task (8 MB); 1,000 columns make one strip.
STRIP_CELLS = 1 << 20
#: A column whose present values differ by less than this share of their squares does not vary: the rest is rounding.
FLAT = 1e-13
_KINDS = ("n", "a", "b", "aa", "bb", "ab")


def _sums(batches, strip: list[int], shift: np.ndarray) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1).astype(np.float64) - shift
        present = ~np.isnan(x)
        x[~present] = 0.0
        m = present.astype(np.float64)
        xs, ms = x[:, strip], m[:, strip]
        part = np.stack([ms.T @ m, xs.T @ m, ms.T @ x, (xs * xs).T @ m, ms.T @ (x * x), xs.T @ x])
        held = part if held is None else held + part
    if held is not None:
        yield _rows(dict(zip(strip, held.transpose(1, 0, 2))))


def _rows(held: dict) -> pa.RecordBatch:
    lists = [pa.array([v[k].tolist() for v in held.values()], pa.list_(pa.float64())) for k in range(len(_KINDS))]
    return pa.record_batch([pa.array(list(held), pa.int32()), *lists], names=["i", *_KINDS])


def _added(batches) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for row, i in enumerate(batch.column(0).to_pylist()):
            part = np.stack([c[row].values.to_numpy() for c in batch.columns[1:]])
            held[i] = held[i] + part if i in held else part
    for i, sums in held.items():
        n, a, b, aa, bb, ab = sums
        with np.errstate(invalid="ignore", divide="ignore"):
            var_a, var_b, cov = aa / n - (a / n) ** 2, bb / n - (b / n) ** 2, ab / n - (a / n) * (b / n)
            flat = (var_a <= FLAT * aa / n) | (var_b <= FLAT * bb / n) | (n < 2)
            den = np.where(flat, 0.0, np.sqrt(np.maximum(var_a, 0)) * np.sqrt(np.maximum(var_b, 0)))
        j = np.flatnonzero((np.arange(len(n)) > i) & (n > 0))
        yield pa.record_batch([pa.array(np.full(len(j), i), pa.int32()), pa.array(j, pa.int32()), pa.array(cov[j]), pa.array(den[j])], names=["i", "j", "cov", "den"])


def pair_moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """(i, j, cov, den) of every pair i < j of numeric ``cols`` with rows where both are present: the population covariance and
    the product of the deviations over those rows, 0 where one of them does not vary."""
    worker_path(df.sparkSession)
    values = [q(c).cast("double") for c in cols]
    values = [F.when(F.isnan(v), F.lit(None)).otherwise(v) for v in values]
    middle = df.agg(*[F.percentile_approx(v, 0.5, 100).alias(f"m{i}") for i, v in enumerate(values)]).first()
    shift = np.array([m or 0.0 for m in middle], np.float64)  # a value of the column itself: a constant one becomes 0
    plain = df.select(*[v.alias(f"c{i}") for i, v in enumerate(values)])
    width = max(1, STRIP_CELLS // len(cols))
    strips = [list(range(at, min(at + width, len(cols)))) for at in range(0, len(cols), width)]
    kinds = ", ".join(f"{k} array<double>" for k in _KINDS)
    parts = [plain.mapInArrow(lambda b, s=s: _sums(b, s, shift), f"i int, {kinds}") for s in strips]
    return reduce(DataFrame.unionByName, parts).repartition("i").mapInArrow(_added, "i int, j int, cov double, den double")
