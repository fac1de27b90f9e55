"""Sequential outlier removal (E3) against a plain loop, and the scans it takes."""

import numpy as np
import pytest

from tabsense.operators import cleaning as C


def _plain(x):
    for i in range(x.shape[1]):
        col = x[:, i][~np.isnan(x[:, i])]
        if len(col) < 2:
            return x[:0]
        m, s = (col.mean(), col.std(ddof=1)) if np.ptp(col) else (col[0], 0.0)
        x = x[(x[:, i] >= m - 3 * s) & (x[:, i] <= m + 3 * s)]  # a missing cell fails
    return x


def _tables():
    rng = np.random.default_rng(3)
    near = rng.normal(size=(3000, 6))
    yield "normal", near.copy()
    linked = near.copy()
    linked[:, 1:] += linked[:, :1] * 2
    linked[:40] *= 30
    yield "outliers of all columns at once", linked
    heavy = rng.lognormal(sigma=2.0, size=(3000, 6))
    heavy[rng.random(heavy.shape) < 0.01] = np.nan
    yield "heavy tails and missing cells", heavy
    huge = near.copy()
    huge[0] = 1e12
    yield "one row holds nearly all of the squared deviations", huge
    flat = near.copy()
    flat[:, 2] = 0.1
    yield "a constant column", flat
    gone = near.copy()
    gone[:, 3] = np.nan
    yield "a column without values", gone


@pytest.mark.parametrize("name, x", list(_tables()), ids=lambda v: v if isinstance(v, str) else "")
def test_removal_equals_a_plain_loop(spark, monkeypatch, name, x):
    scans, stats = [], C.column_stats
    monkeypatch.setattr(C, "column_stats", lambda *a, **k: scans.append(1) or stats(*a, **k))
    names = [f"c {i}" for i in range(x.shape[1])]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"`{n}` double" for n in names))
    got = sorted(tuple(r) for r in C.remove_outliers(df).collect())
    assert got == sorted(tuple(r) for r in _plain(x).tolist())
    if name == "normal":
        assert len(scans) == 1  # with the one that sets rows aside and the result: three reads of the source


def test_removal_of_odd_tables(spark):
    empty = spark.createDataFrame([], "a double, b int")
    assert C.remove_outliers(empty).collect() == []
    assert C.remove_outliers(spark.createDataFrame([(1.0, 2)], "a double, b int")).collect() == []
    inf = spark.createDataFrame([(float(i), float("inf") if i == 0 else float(i)) for i in range(50)], "a double, b double")
    assert C.remove_outliers(inf).collect() == []  # an infinite cell leaves no bounds
    text = spark.createDataFrame([("x",)], "t string")
    assert C.remove_outliers(text).count() == 1
