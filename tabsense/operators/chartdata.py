"""The data behind the charts (L1, L3, N3, N4, N5) and row previews (K1).

Drawing is not done here; each function returns the small table a chart
library plots.  All of them aggregate the whole table in Spark; only
bounded results (bins, quartiles, k sampled rows) come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.functions.columns import nan_as_missing, name_of, pick, q, unpivot_numeric
from tabsense.functions.quantiles import quantiles
from tabsense.functions.stats import column_stats
from tabsense.operators.cleaning import IQR_FACTOR, analysis_numeric_columns

DEFAULT_BINS = 30          # fixed value: histogram bins
HISTOGRAM_COLUMNS = 4      # fixed value: first numeric columns charted
CATEGORY_COLUMNS = 3       # fixed value: first text columns charted
CATEGORY_TOP = 10          # fixed value: bars per text column


@nan_as_missing
def histograms(df: DataFrame, cols: list[str] | None = None, bins: int = DEFAULT_BINS) -> DataFrame:
    """L1: equal-width bins between min and max of each column (the last bin
    closed), empty bins included: (column_name, bin, bin_start, bin_end, count).

    One aggregation gives the ranges; one unpivot + ``groupBy`` counts every
    column's bins in a single shuffle of at most columns x bins partial rows
    per task; the bin grid (columns x bins rows) is broadcast."""
    cols = cols if cols is not None else analysis_numeric_columns(df)[:HISTOGRAM_COLUMNS]
    spark = df.sparkSession
    schema = "column_name string, bin int, bin_start double, bin_end double, count bigint"
    if not cols:
        return spark.createDataFrame([], schema)
    st = column_stats(df, cols, a=F.min, b=F.max)
    grid, cases = [], []
    for c in cols:
        mn, mx = st[c]["a"], st[c]["b"]
        if mn is None:
            continue
        w = (mx - mn) / bins
        nb = bins if w > 0 else 1
        for b in range(nb):
            grid.append((c, b, mn + b * w, mn + (b + 1) * w if w > 0 else mx))
        x = q(c).cast("double")
        idx = F.lit(0) if w == 0 else F.least(F.floor((x - F.lit(mn)) / F.lit(w)), F.lit(bins - 1)).cast("int")
        cases.append(F.struct(F.lit(c).alias("column_name"), F.when(x.isNotNull(), idx).alias("bin")))
    if not grid:
        return spark.createDataFrame([], schema)
    counts = (df.select(F.explode(F.array(*cases)).alias("s")).select("s.*")
              .where(F.col("bin").isNotNull())
              .groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias("count")))
    g = spark.createDataFrame(grid, "column_name string, bin int, bin_start double, bin_end double")
    return (counts.join(F.broadcast(g), ["column_name", "bin"], "right")
            .select("column_name", "bin", F.bround("bin_start", 4).alias("bin_start"),
                    F.bround("bin_end", 4).alias("bin_end"),
                    F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


@nan_as_missing
def box_stats(df: DataFrame, cols: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Quartiles, fences at 1.5 IQR, whiskers at the most extreme values
    inside the fences, and the outlier count, per numeric column."""
    cols = cols if cols is not None else analysis_numeric_columns(df)
    spark = df.sparkSession
    schema = ("column_name string, n bigint, q1 double, median double, q3 double, lower_fence double, "
              "upper_fence double, whisker_low double, whisker_high double, outliers bigint")
    qs = quantiles(df, cols, [0.25, 0.5, 0.75], exact=exact)
    present = [c for c in cols if qs[(c, 0.5)] is not None]
    if not present:
        return spark.createDataFrame([], schema)
    q1s = [qs[(c, 0.25)] for c in present]
    meds = [qs[(c, 0.5)] for c in present]
    q3s = [qs[(c, 0.75)] for c in present]
    los = [a - IQR_FACTOR * (b - a) for a, b in zip(q1s, q3s)]
    his = [b + IQR_FACTOR * (b - a) for a, b in zip(q1s, q3s)]
    # one grouped aggregate over the unpivoted values (small buffer per column)
    pos, x = F.col("position"), F.col("x")
    lo, hi = pick(los, pos), pick(his, pos)
    inside = (x >= lo) & (x <= hi)
    g = unpivot_numeric(df, present).groupBy("position").agg(
        F.count(x).alias("n"), F.min(F.when(inside, x)).alias("_wl"), F.max(F.when(inside, x)).alias("_wh"),
        F.count(F.when(x.isNotNull() & ~inside, 1)).alias("outliers"))
    return g.select(
        name_of(pos, present).alias("column_name"), "n",
        F.bround(pick(q1s, pos), 4).alias("q1"), F.bround(pick(meds, pos), 4).alias("median"),
        F.bround(pick(q3s, pos), 4).alias("q3"), F.bround(lo, 4).alias("lower_fence"),
        F.bround(hi, 4).alias("upper_fence"), F.bround("_wl", 4).alias("whisker_low"),
        F.bround("_wh", 4).alias("whisker_high"), "outliers")


def md5_rank(key: str, seed: int = 42):
    """Deterministic pseudo-random 32-bit rank of a row from its key (the same
    value in DuckDB: md5 of key text followed by the seed)."""
    return F.conv(F.substring(F.md5(F.concat(q(key).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint")


@nan_as_missing
def scatter_sample(df: DataFrame, x: str, y: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """At most ``n`` (key, x, y) points, the rows with the smallest md5
    rank.  A bounded top-n (``TakeOrderedAndProject``: each task keeps n)."""
    return (df.select(q(key).alias(key), q(x).alias(x), q(y).alias(y), md5_rank(key, seed).alias("_r"))
            .where(q(x).isNotNull() & q(y).isNotNull())
            .orderBy("_r", key).limit(n).drop("_r"))


GRAINS = ("year", "quarter", "month", "week", "day", "hour")


@nan_as_missing
def time_series(df: DataFrame, ts: str, value: str, grain: str = "day") -> DataFrame:
    """(period, n, total, mean) of ``value`` per ``grain`` of ``ts``."""
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}")
    period = F.date_trunc(grain, q(ts))
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        period = period.cast("timestamp_ntz")
    v = q(value).cast("double")
    return (df.where(q(ts).isNotNull()).groupBy(period.alias("period"))
            .agg(F.count(F.lit(1)).alias("n"), F.bround(F.sum(v), 4).alias("total"),
                 F.bround(F.avg(v), 4).alias("mean")))


def preview(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """K1: the first ``n`` rows in ``order_by`` order (Spark rows have no
    intrinsic order; a bounded top-n)."""
    return df.orderBy(*[q(c) for c in order_by]).limit(n)
