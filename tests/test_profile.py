import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsense.functions import comoments
from tabsense.functions.quantiles import exact_quantiles
from tabsense.operators import profile as P


def _frame(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.gamma(2.0, 3.0, n)
    y = 0.5 * x + rng.normal(0, 1, n)
    z = np.where(rng.random(n) < 0.1, np.nan, rng.normal(10, 2, n))
    pdf = pd.DataFrame({"x": x, "y": y, "z": z})
    sdf = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in pdf.itertuples(index=False)],
                                "x double, y double, z double")
    return pdf, sdf


def test_moments_match_pandas(spark):
    pdf, sdf = _frame(spark)
    rows = {r["column_name"]: r for r in P.profile_numeric(sdf).collect()}
    for c in ["x", "y", "z"]:
        s = pdf[c].dropna()
        assert abs(rows[c]["mean"] - s.mean()) < 1e-4
        assert abs(rows[c]["std"] - s.std()) < 1e-4
        assert abs(rows[c]["skewness"] - s.skew()) < 1e-4
        assert abs(rows[c]["kurtosis"] - s.kurtosis()) < 1e-4
        assert abs(rows[c]["median"] - s.median()) < 1e-4
        assert abs(rows[c]["q1"] - s.quantile(0.25)) < 1e-4


def test_exact_quantiles_with_forced_refinement(spark):
    pdf, sdf = _frame(spark, n=3000)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(sdf, ["x", "z"], probs, collect_bound=20, grid=8)
    for c in ["x", "z"]:
        for p in probs:
            assert abs(got[(c, p)] - pdf[c].dropna().quantile(p)) < 1e-9


def test_quantiles_hot_value(spark):
    # a third of the rows hold one value: the bracket collapses to it
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(F.col("id") * 1.0).alias("v"))
    pdf = df.toPandas()
    got = exact_quantiles(df, ["v"], [0.1, 0.5, 0.9], collect_bound=50, grid=8)
    for p in [0.1, 0.5, 0.9]:
        assert abs(got[("v", p)] - pdf["v"].quantile(p)) < 1e-9


def test_quantiles_overlapping_brackets_with_ties(spark):
    # 41 targets close together on a column of few distinct values: the
    # brackets overlap and the counts below them come from gap ids
    df = spark.range(5000).select((F.col("id") * 7 % 97).cast("double").alias("v"),
                                  F.when(F.col("id") % 4 == 0, None).otherwise(F.sqrt("id")).alias("w"))
    pdf = df.toPandas()
    probs = [i / 40 for i in range(41)]
    got = exact_quantiles(df, ["v", "w"], probs, collect_bound=30, grid=8)
    for c in ["v", "w"]:
        for p in probs:
            assert abs(got[(c, p)] - pdf[c].dropna().quantile(p)) < 1e-9


def test_correlation_constant_column_is_undefined(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.1), (3.0, 5.0, 6.3)], "a double, b double, c double")
    pairs = {(r["variable_1"], r["variable_2"]): r["correlation"] for r in P.correlation_pairs(df).collect()}
    assert pairs[("a", "b")] is None
    assert abs(pairs[("a", "c")] - pd.Series([1, 2, 3.0]).corr(pd.Series([2, 4.1, 6.3]))) < 1e-4
    top = P.top_correlations(df).collect()
    assert all(r["correlation"] is not None for r in top)


def test_pairwise_complete_corr(spark):
    pdf, sdf = _frame(spark)
    pairs = {(r["variable_1"], r["variable_2"]): r["correlation"] for r in P.correlation_pairs(sdf).collect()}
    assert abs(pairs[("x", "z")] - pdf["x"].corr(pdf["z"])) < 1e-4


def test_histogram_counts_sum(spark):
    from tabsense.operators.chartdata import histograms
    _, sdf = _frame(spark)
    h = histograms(sdf, ["x", "z"]).groupBy("column_name").agg(F.sum("count").alias("n")).collect()
    n = {r["column_name"]: r["n"] for r in h}
    assert n["x"] == 400 and n["z"] == sdf.where("z is not null").count()


def test_top_values_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "v string")
    rows = P.top_values(df, ["v"], 2).orderBy("rank").collect()
    assert [(r["value"], r["count"]) for r in rows] == [("c", 2), ("a", 1)]


def _plain_pairs(x):
    """Correlations over pairwise-complete rows by numpy, None where undefined."""
    out = {}
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[ok, i], x[ok, j]
            out[i, j] = None if len(a) < 2 or len(set(a)) < 2 or len(set(b)) < 2 else float(np.corrcoef(a, b)[0, 1])
    return out


@pytest.mark.parametrize("cells", [1 << 20, 12])
def test_pair_moments_equal_numpy(spark, monkeypatch, cells):
    """Missing and NaN cells, a constant, a column far from zero, a column that is constant where another is present."""
    monkeypatch.setattr(comoments, "STRIP_CELLS", cells)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6))
    x[:, 1] = 0.5 * x[:, 0] + 0.1 * x[:, 1]
    x[:, 2] = 0.1
    x[:, 3] = 1e7 + x[:, 0] + 0.5 * x[:, 3]
    x[rng.random((300, 6)) < 0.2] = np.nan
    x[:, 5] = np.where(np.isnan(x[:, 4]), x[:, 5], 0.3)
    x[:150, 0] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) and i % 2 else float(v) for v in r) for i, r in enumerate(x)], ", ".join(f"c{i} double" for i in range(6))).repartition(4)
    want = _plain_pairs(x)
    got = {(r.i, r.j): r.correlation for r in P.correlation_pairs(df, digits=None).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-7), (k, got[k], v)


def test_correlations_of_three_hundred_columns(spark):
    df = spark.range(2000).select(*[((F.col("id") * (i + 3)) % (17 + i)).cast("double").alias(f"c{i}") for i in range(300)])
    pairs = P.correlation_pairs(df, digits=None)
    assert pairs.count() == 300 * 299 // 2
    r = pairs.where("i = 3 and j = 299").first()["correlation"]
    k = np.arange(2000)
    assert abs(r - np.corrcoef(k * 6 % 20, k * 302 % 316)[0, 1]) < 1e-9


def test_correlations_of_few_rows(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0)], "a double, b double")
    for rows in (df, df.where("false")):
        assert [tuple(r) for r in P.correlation_pairs(rows).collect()] == [(0, 1, "a", "b", None)]
