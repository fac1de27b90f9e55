"""Profile and statistics.

Every statistic family is one aggregation over the whole table: moments,
counts and sign counts of all columns, and the correlations of all column
pairs, come from one unpivot grouped by column (or pair) position; exact
quantiles through bracket refinement; distinct values and frequencies through
a single unpivot of value hashes + ``groupBy``.  Results are small long-form DataFrames, one row per column
or per column pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.functions.columns import (nan_as_missing, categorical_columns, name_of, numeric_columns, q,
                                        unpivot_numeric)
from tabsense.functions.comoments import pair_moments
from tabsense.functions.frequencies import frequent_values, hashed_distinct_counts, top_k
from tabsense.functions.quantiles import quantiles
from tabsense.functions.stats import column_stats, merge_rows, round_sig, strength_label
from tabsense.operators.cleaning import STD_FACTOR, outlier_report
from tabsense.operators.quality import table_counts


def _numeric_moments(df: DataFrame, cols: list[str], digits: int) -> DataFrame:
    """One row per column: moments, extremes, sign counts, missing.

    The statistics come from the unpivoted values grouped by column position
    (small aggregation buffer, whole-stage codegen at any width); rounding is
    applied once per statistic on the grouped rows."""
    n = "count(x)"
    sd = "stddev_pop(x)"
    skew = (f"CASE WHEN {n} < 3 THEN CAST(NULL AS DOUBLE) WHEN {sd} = 0 THEN 0D "
            f"ELSE skewness(x) * sqrt({n} * ({n} - 1D)) / ({n} - 2D) END")
    kurt = (f"CASE WHEN {n} < 4 THEN CAST(NULL AS DOUBLE) WHEN {sd} = 0 THEN 0D "
            f"ELSE ({n} - 1D) / (({n} - 2D) * ({n} - 3D)) * (({n} + 1D) * kurtosis(x) + 6D) END")
    nulls = "CAST(count(*) - count(x) AS BIGINT)"
    raw = unpivot_numeric(df, cols).groupBy("position").agg(
        F.expr(f"{n} AS count"), F.expr(f"{nulls} AS missing"),
        F.expr(f"{nulls} / count(*) * 100D AS missing_pct"), F.expr("avg(x) AS mean"),
        F.expr("stddev_samp(x) AS std"), F.expr("var_samp(x) AS var"), F.expr("min(x) AS min"),
        F.expr("max(x) AS max"), F.expr("max(x) - min(x) AS range"), F.expr(f"{skew} AS skewness"),
        F.expr(f"{kurt} AS kurtosis"), F.expr("count(CASE WHEN x = 0 THEN 1 END) AS zero_count"),
        F.expr("count(CASE WHEN x < 0 THEN 1 END) AS negative_count"),
        F.expr("count(CASE WHEN x > 0 THEN 1 END) AS positive_count"))
    return raw.select(
        "position", name_of(F.col("position"), cols).alias("column_name"), "count", "missing",
        F.bround("missing_pct", 2).alias("missing_pct"),
        *[round_sig(k, digits).alias(k) for k in ("mean", "std", "var", "min", "max", "range")],
        F.bround("skewness", digits).alias("skewness"), F.bround("kurtosis", digits).alias("kurtosis"),
        "zero_count", "negative_count", "positive_count")


def _quantile_frame(df: DataFrame, cols: list[str], exact: bool, digits: int) -> DataFrame:
    qs = quantiles(df, cols, [0.25, 0.5, 0.75], exact=exact)
    rows = []
    for c in cols:
        q1, med, q3 = qs[(c, 0.25)], qs[(c, 0.5)], qs[(c, 0.75)]
        rows.append((c, q1, med, q3, None if q1 is None else q3 - q1))
    return df.sparkSession.createDataFrame(
        rows, "column_name string, q1 double, median double, q3 double, iqr double").select(
        "column_name", *[round_sig(c, digits).alias(c) for c in ("q1", "median", "q3", "iqr")])


@nan_as_missing
def profile_numeric(df: DataFrame, exact: bool = True) -> DataFrame:
    """H2: one row per numeric column that holds at least one value."""
    cols = numeric_columns(df)
    schema = ("column_name string, count bigint, missing bigint, missing_pct double, mean double, "
              "median double, std double, var double, min double, max double, range double, q1 double, "
              "q3 double, iqr double, skewness double, kurtosis double, unique_values bigint, "
              "zero_count bigint, negative_count bigint, positive_count bigint")
    if not cols:
        return df.sparkSession.createDataFrame([], schema)
    mom = _numeric_moments(df, cols, 4).where(F.col("count") > 0)
    qf = _quantile_frame(df, cols, exact, 4)
    uniq = (hashed_distinct_counts(df, cols).withColumnRenamed("n_unique", "unique_values") if exact else
            unpivot_numeric(df, cols).groupBy("position").agg(F.approx_count_distinct("x").alias("unique_values"))
            .select(name_of(F.col("position"), cols).alias("column_name"), "unique_values"))
    # both right-hand sides hold one row per column: a bounded broadcast
    out = mom.join(F.broadcast(qf), "column_name").join(F.broadcast(uniq), "column_name", "left")
    return out.select("column_name", "count", "missing", "missing_pct", "mean", "median", "std", "var",
                      "min", "max", "range", "q1", "q3", "iqr", "skewness", "kurtosis",
                      F.coalesce("unique_values", F.lit(0)).cast("bigint").alias("unique_values"),
                      "zero_count", "negative_count", "positive_count")


@nan_as_missing
def describe_numeric(df: DataFrame, digits: int = 3, exact: bool = True) -> DataFrame:
    """H6: pandas ``describe`` plus skewness, kurtosis, missing and missing %
    for every numeric column (all-null columns included, statistics NULL)."""
    cols = numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column_name string, count double, mean double, std double, min double, p25 double, "
                "p50 double, p75 double, max double, skewness double, kurtosis double, missing double, "
                "missing_pct double")
    mom = _numeric_moments(df, cols, digits)
    qf = _quantile_frame(df, cols, exact, digits)
    out = mom.join(F.broadcast(qf), "column_name")
    return out.select(
        "column_name", F.col("count").cast("double").alias("count"), "mean", "std", "min",
        F.col("q1").alias("p25"), F.col("median").alias("p50"), F.col("q3").alias("p75"), "max",
        "skewness", "kurtosis", F.col("missing").cast("double").alias("missing"),
        F.bround("missing_pct", digits).alias("missing_pct"))


@nan_as_missing
def profile_categorical(df: DataFrame, top: int = 5) -> DataFrame:
    """H3: one row per text column holding at least one value: count,
    missing, missing %, unique values, most frequent value with its count
    and % of non-null values, and the top-``top`` list as text
    ``value=count; ...`` (count desc, value asc)."""
    cats = categorical_columns(df)
    if not cats:
        return df.sparkSession.createDataFrame(
            [], "column_name string, count bigint, missing bigint, missing_pct double, unique_values bigint, "
                "most_frequent string, most_frequent_count bigint, most_frequent_pct double, top_values string")
    tops = frequent_values(df, cats, top).where("n_unique > 0")
    first = F.col("rank") == 1
    out = tops.groupBy("column_name").agg(
        F.max("known").alias("count"), F.max("missing").alias("missing"), F.max("n_unique").alias("unique_values"),
        F.max(F.when(first, F.col("value"))).alias("most_frequent"), F.max(F.when(first, F.col("count"))).alias("most_frequent_count"),
        F.sort_array(F.collect_list(F.struct("rank", "value", "count"))).alias("t"))  # ``top`` rows per column
    return out.select(
        "column_name", "count", "missing",
        F.bround(F.col("missing") / (F.col("count") + F.col("missing")) * 100, 2).alias("missing_pct"),
        "unique_values", "most_frequent", "most_frequent_count",
        F.bround(F.col("most_frequent_count") / F.col("count") * 100, 2).alias("most_frequent_pct"),
        F.array_join(F.transform("t", lambda s: F.concat(s["value"], F.lit("="), s["count"].cast("string"))), "; ").alias("top_values"))


@nan_as_missing
def top_values(df: DataFrame, cols: list[str] | None = None, k: int = 10) -> DataFrame:
    """K2 / L3: (column_name, rank, value, count) for the k most frequent
    values of each column; ties by value ascending."""
    cols = cols if cols is not None else categorical_columns(df)
    return top_k(df, cols, k)


@nan_as_missing
def frequency_table(df: DataFrame, col: str, k: int = 20) -> DataFrame:
    """Top-k values of one column with count and % of *all* rows (2 dp)."""
    return frequent_values(df, [col], k).where(F.col("rank").isNotNull()).select(
        "rank", "value", "count", F.bround(F.col("count") / (F.col("known") + F.col("missing")) * 100, 2).alias("percentage"))


@nan_as_missing
def frequency_summary(df: DataFrame, col: str) -> DataFrame:
    """H10 header: distinct values, most common value, missing cells."""
    return frequent_values(df, [col], 1).select("column_name", F.col("n_unique").alias("unique_values"),
                                                F.col("value").alias("most_common"), "missing")


# --- correlations -----------------------------------------------------------

@nan_as_missing
def correlation_pairs(df: DataFrame, cols: list[str] | None = None, digits: int | None = 4) -> DataFrame:
    """(i, j, variable_1, variable_2, correlation) for every pair i<j of
    numeric columns; NULL when undefined (constant or too few pairs).

    The pairs' sums come from matrix products over blocks of columns: a task
    gives one row per column, whatever the number of rows and pairs."""
    cols = cols if cols is not None else numeric_columns(df)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    schema = "i int, j int, variable_1 string, variable_2 string, correlation double"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    every = F.broadcast(df.sparkSession.createDataFrame(pairs, "i int, j int"))  # a pair without a common row is there too
    g = every.join(pair_moments(df, cols), ["i", "j"], "left")
    r = F.when(F.col("den") > 0, F.try_divide(F.col("cov"), F.col("den")))
    return g.select("i", "j", name_of(F.col("i"), cols).alias("variable_1"),
                    name_of(F.col("j"), cols).alias("variable_2"),
                    (F.bround(r, digits) if digits is not None else r).alias("correlation"))


@nan_as_missing
def top_correlations(df: DataFrame, k: int = 10, strict: bool = False, keep_undefined: bool = False,
                     digits: int = 4) -> DataFrame:
    """H5 (``strict=False``: bands >= 0.7 / >= 0.4, undefined pairs dropped)
    and H8 (``strict=True, keep_undefined=True``: bands > 0.7 / > 0.4,
    undefined pairs kept last as Weak).  Sorted by |r| desc, then pair order."""
    p = correlation_pairs(df, digits=digits)
    if not keep_undefined:
        p = p.where(F.col("correlation").isNotNull())
    p = p.withColumn("strength", strength_label(F.col("correlation"), strict))
    return (p.orderBy(F.abs("correlation").desc_nulls_last(), "i", "j").limit(k)
            .select("variable_1", "variable_2", "correlation", "strength"))


@nan_as_missing
def correlation_matrix(df: DataFrame, digits: int = 4) -> DataFrame:
    """H7 / L2 long form (var_a, var_b, r): both triangles and the diagonal."""
    cols = numeric_columns(df)
    p = correlation_pairs(df, cols, digits=None)
    stds = unpivot_numeric(df, cols).groupBy("position").agg(
        F.stddev_pop("x").alias("s"), F.count("x").alias("n"))
    name = name_of(F.col("position"), cols)
    diag = stds.select(name.alias("var_a"), name.alias("var_b"),
                       F.when((F.col("s") > 0) & (F.col("n") > 1), F.lit(1.0)).alias("r"))
    upper = p.select(F.col("variable_1").alias("var_a"), F.col("variable_2").alias("var_b"),
                     F.col("correlation").alias("r"))
    lower = p.select(F.col("variable_2").alias("var_a"), F.col("variable_1").alias("var_b"),
                     F.col("correlation").alias("r"))
    return upper.unionByName(lower).unionByName(diag).select("var_a", "var_b", F.bround("r", digits).alias("r"))


@nan_as_missing
def strongest_pair(df: DataFrame) -> DataFrame:
    """H9: the pair with the largest |r| below 1 (first in pair order on
    ties), |r| to 3 dp; no row when every |r| is 0, 1 or undefined."""
    p = correlation_pairs(df, digits=None).withColumn("a", F.abs("correlation"))
    p = p.where((F.col("a") > 0) & (F.col("a") < 1))
    return (p.orderBy(F.desc("a"), "i", "j").limit(1)
            .select("variable_1", "variable_2", F.bround("a", 3).alias("abs_correlation")))


# --- quality from the profile (G2) and documented extras (N1, N2) -----------

@nan_as_missing
def profile_quality(df: DataFrame, exact: bool = True) -> DataFrame:
    """Completeness and uniqueness (2 dp), outlier penalty = mean IQR
    outlier % over numeric columns with values, overall = (c + u - penalty)/2,
    grade from completeness (> 95 Excellent, > 80 Good, > 60 Fair, else Poor)."""
    ncols = len(df.columns)
    t = table_counts(df)
    orep = outlier_report(df, exact=exact)
    pen = orep.agg(F.coalesce(F.avg("outlier_percentage"), F.lit(0.0)).alias("penalty"))
    rows, cells = F.col("total_rows"), F.col("total_rows") * ncols
    comp = F.when(cells > 0, (1 - F.col("missing_cells") / cells) * 100).otherwise(F.lit(0.0))
    uniq = F.when(rows > 0, (1 - F.col("duplicate_rows") / rows) * 100).otherwise(F.lit(0.0))
    return merge_rows(t, pen).select(
        F.bround(comp, 2).alias("completeness_score"),
        F.bround(uniq, 2).alias("uniqueness_score"),
        F.bround((comp + uniq - F.col("penalty")) / 2, 2).alias("overall_quality_score"),
        F.when(comp > 95, "Excellent").when(comp > 80, "Good").when(comp > 60, "Fair").otherwise("Poor")
        .alias("quality_grade"))


@nan_as_missing
def normality(df: DataFrame) -> DataFrame:
    """Jarque-Bera per numeric column, JB = n/6 (g1^2 + g2^2/4) with the
    population skewness g1 and excess kurtosis g2; p = exp(-JB/2) (chi-square,
    2 df).  Scales to any n, unlike Shapiro-Wilk."""
    cols = numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, n bigint, jarque_bera double, "
                                                   "p_value double, normal_at_5pct boolean")
    x = F.col("x")
    n = F.count(x)
    jb = n / 6 * (F.pow(F.skewness(x), 2) + F.pow(F.kurtosis(x), 2) / 4)
    jb = F.when((n >= 3) & (F.stddev_pop(x) > 0), jb)
    g = unpivot_numeric(df, cols).groupBy("position").agg(n.alias("n"), jb.alias("jb"))
    return g.select(name_of(F.col("position"), cols).alias("column_name"), "n",
                    F.bround("jb", 4).alias("jarque_bera"),
                    F.bround(F.exp(-F.col("jb") / 2), 6).alias("p_value"),
                    (F.exp(-F.col("jb") / 2) >= 0.05).alias("normal_at_5pct"))


# Weights of the documented weighted quality score.
WEIGHTS = {"completeness": 0.35, "validity": 0.25, "consistency": 0.20, "duplicates": 0.20}


@nan_as_missing
def weighted_quality(df: DataFrame) -> DataFrame:
    """Weighted score 35 % completeness, 25 % validity, 20 % consistency,
    20 % non-duplication (all in %, 2 dp).

    validity   = % of rows with no numeric value beyond mean -+ 3 sample std;
    consistency = % of columns that are not mixed-type, where a text column is
                 mixed when it holds both values castable to double and values
                 that are not (``try_cast``)."""
    nums, cats = numeric_columns(df), categorical_columns(df)
    ncols = len(df.columns)
    mom = column_stats(df, nums, m=F.avg, s=F.stddev_samp)
    beyond = F.lit(False)
    for c in nums:
        m, s = mom[c]["m"], mom[c]["s"]
        if m is not None and s is not None:
            beyond = beyond | F.coalesce((F.abs(q(c) - F.lit(m)) > STD_FACTOR * s), F.lit(False))
    mixed = []
    for c in cats:
        ok = F.expr(f"try_cast(`{c.replace('`', '``')}` AS DOUBLE)").isNotNull()
        mixed.append((F.max(F.when(q(c).isNotNull() & ok, 1)).isNotNull()
                      & F.max(F.when(q(c).isNotNull() & ~ok, 1)).isNotNull()).cast("int"))
    agg = df.agg(F.count(F.lit(1)).alias("rows"),
                 F.count(F.when(~beyond, 1)).alias("valid_rows"),
                 (sum(mixed, F.lit(0)) if mixed else F.lit(0)).alias("mixed_columns"))
    t = table_counts(df)
    rows, cells = F.col("total_rows"), F.col("total_rows") * ncols
    comp = F.when(cells > 0, (1 - F.col("missing_cells") / cells) * 100).otherwise(F.lit(0.0))
    valid = F.when(rows > 0, F.col("valid_rows") / rows * 100).otherwise(F.lit(0.0))
    cons = F.when(F.lit(ncols) > 0, (1 - F.col("mixed_columns") / F.lit(ncols)) * 100).otherwise(F.lit(0.0))
    dup = F.when(rows > 0, (1 - F.col("duplicate_rows") / rows) * 100).otherwise(F.lit(0.0))
    w = WEIGHTS
    return merge_rows(t, agg).select(
        F.bround(comp, 2).alias("completeness"), F.bround(valid, 2).alias("validity"),
        F.bround(cons, 2).alias("consistency"), F.bround(dup, 2).alias("uniqueness"),
        F.bround(w["completeness"] * comp + w["validity"] * valid + w["consistency"] * cons
                 + w["duplicates"] * dup, 2).alias("weighted_score"))
