"""Row and column cleaning operators.

Each operator is ``DataFrame -> DataFrame``.  Statistics an operator needs
(medians, bounds, distinct counts) are computed by one aggregation over the
input and folded into the returned plan as literals; no rows go to the
driver.  Operators that report how much they changed return the count as a
second value via the ``*_with_count`` variants used by the cleaning plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.functions.columns import (nan_as_missing, INDEX_LIKE_NAMES, categorical_columns, name_of,
                                        numeric_columns, pick, q, unpivot_numeric)
from tabsense.functions.frequencies import hashed_distinct_counts, top_k
from tabsense.functions.ordered_fill import ordered_fill
from tabsense.functions.quantiles import quantiles
from tabsense.functions.stats import column_stats, null_counts
from tabsense.session import shared_scratch

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's.
UNKNOWN_LABEL = "Unknown"        # categorical fill "Unknown"
MISSING_LABEL = "Missing"        # categorical feature fill before encoding
DEFAULT_MISSING_THRESHOLD = 50   # % of columns a row may miss
DEFAULT_CARDINALITY = 100        # distinct values above which a text column goes
STD_FACTOR = 3.0                 # mean +- 3 standard deviations
CONSTANT_BATCH = 40              # two buffers each stay below the 100 fields of generated code
IQR_FACTOR = 1.5                 # Q1 - 1.5 IQR, Q3 + 1.5 IQR
# ---------------------------------------------------------------------------


# --- B3 ---------------------------------------------------------------------

def drop_index_columns(df: DataFrame) -> DataFrame:
    """Drop ``Unnamed: 0``; drop ``index`` when its values are exactly
    0..n-1 (order-free test: no NULL, min 0, max n-1, n distinct)."""
    out = df.drop("Unnamed: 0") if "Unnamed: 0" in df.columns else df
    if "index" in out.columns and isinstance(out.schema["index"].dataType, T.IntegralType):
        r = out.agg(F.count(F.lit(1)).alias("n"), F.count("index").alias("nn"),
                    F.min("index").alias("mn"), F.max("index").alias("mx"),
                    F.count_distinct("index").alias("nd")).first()
        if r["n"] == r["nn"] == r["nd"] and (r["n"] == 0 or (r["mn"] == 0 and r["mx"] == r["n"] - 1)):
            out = out.drop("index")
    return out


def analysis_numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns minus index-like names (chart inputs)."""
    return [c for c in numeric_columns(df) if c not in INDEX_LIKE_NAMES]


# --- B4-B7 ------------------------------------------------------------------

@nan_as_missing
def drop_missing(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """B6 (all columns) / B4 (``subset``, e.g. the target): drop rows with a
    missing cell."""
    return df.na.drop(how="any", subset=subset)


@nan_as_missing
def select_features(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """Target plus features (default: every other column), rows with a
    known target only."""
    feats = features if features is not None else [c for c in df.columns if c != target]
    return drop_missing(df, [target]).select(*[q(c) for c in feats], q(target))


def missing_per_row(cols: list[str]) -> Column:
    if not cols:
        return F.lit(0)
    return sum((q(c).isNull().cast("int") for c in cols), F.lit(0))


@nan_as_missing
def drop_sparse_rows(df: DataFrame, max_missing_pct: float = DEFAULT_MISSING_THRESHOLD) -> DataFrame:
    """Keep rows missing at most int(ncols*pct/100) cells; no-op at 100."""
    if max_missing_pct >= 100:
        return df
    k = int(len(df.columns) * max_missing_pct / 100)
    return df.where(missing_per_row(df.columns) <= k)


# --- B8-B10 -----------------------------------------------------------------

def _orderable(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.MapType, T.StructType, T.ArrayType, T.BinaryType))


@nan_as_missing
def constant_columns(df: DataFrame) -> list[str]:
    """Columns with exactly one distinct non-null value (all-null columns
    have none and are kept).  Constant iff min = max of the typed values, in
    aggregates of ``CONSTANT_BATCH`` columns each, which read only those."""
    cols = [f.name for f in df.schema.fields if _orderable(f.dataType)]
    if not cols:
        return []
    found = []
    for at in range(0, len(cols), CONSTANT_BATCH):
        some = cols[at:at + CONSTANT_BATCH]
        # compared inside Spark: a timestamp that leaves it loses its offset
        r = df.agg(*[(F.min(q(c)) == F.max(q(c))).alias(f"c{i}") for i, c in enumerate(some)]).first()
        found += [c for i, c in enumerate(some) if r[f"c{i}"]]
    return found


@nan_as_missing
def drop_constant_columns(df: DataFrame) -> DataFrame:
    """B8."""
    const = constant_columns(df)
    return df.drop(*const) if const else df


@nan_as_missing
def high_cardinality_columns(df: DataFrame, max_unique: int = DEFAULT_CARDINALITY) -> list[str]:
    """Categorical columns with more than ``max_unique`` distinct values.

    A HyperLogLog estimate per column decides those far from the limit (over
    five standard errors); the others are counted exactly by value hash."""
    cats = categorical_columns(df)
    if not cats:
        return []
    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("position"), q(c).alias("x")) for i, c in enumerate(cats)])))
    rough = {r["position"]: r["n"] for r in long.groupBy("position").agg(F.approx_count_distinct("x", 0.02).alias("n")).collect()}
    near = [c for i, c in enumerate(cats) if 0.9 * max_unique - 5 <= rough.get(i, 0) <= 1.1 * max_unique + 5]
    exact = {r["column_name"]: r["n_unique"] for r in hashed_distinct_counts(df, near).collect()} if near else {}
    return [c for i, c in enumerate(cats) if (exact.get(c, 0) if c in near else rough.get(i, 0)) > max_unique]


@nan_as_missing
def drop_high_cardinality(df: DataFrame, max_unique: int = DEFAULT_CARDINALITY) -> DataFrame:
    """B9."""
    hc = high_cardinality_columns(df, max_unique)
    return df.drop(*hc) if hc else df


def standard_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_").replace("-", "_")


def standardize_names(df: DataFrame) -> DataFrame:
    """Strip, lower-case, space and hyphen to underscore; a name that
    collides with an earlier one gets ``_2``, ``_3``, ... (Spark needs unique
    names where pandas tolerated repeats)."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = standard_name(c)
        if n in seen:
            seen[n] += 1
            cand = f"{n}_{seen[n]}"
            while cand in seen:
                seen[n] += 1
                cand = f"{n}_{seen[n]}"
            n = cand
        seen.setdefault(n, 1)
        names.append(n)
    return df.select(*[q(c).alias(n) for c, n in zip(df.columns, names)])


def dedupe_names(names: list[str]) -> list[str]:
    """Duplicate headers as pandas names them: ``id``, ``id.1``, ``id.2``
    (with ``_`` for ``.`` so Spark column paths stay plain)."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        if n in seen:
            seen[n] += 1
            out.append(f"{n}_{seen[n]}")
        else:
            seen[n] = 0
            out.append(n)
    return out


# --- C2 ---------------------------------------------------------------------

@nan_as_missing
def drop_duplicates(df: DataFrame) -> DataFrame:
    """Exact duplicate rows removed (NULLs equal).  Map columns cannot be
    grouped in Spark, so they are compared through their JSON text."""
    maps = [f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)]
    if not maps:
        return df.dropDuplicates()
    keyed = df.withColumns({f"_j{i}": F.to_json(q(c)) for i, c in enumerate(maps)})
    keys = [c for c in df.columns if c not in maps] + [f"_j{i}" for i in range(len(maps))]
    return keyed.dropDuplicates(keys).select(*[q(c) for c in df.columns])


# --- D1-D9 ------------------------------------------------------------------

def columns_with_missing(df: DataFrame, cols: list[str], counts: dict[str, int] | None = None) -> list[str]:
    """Columns of ``cols`` holding a missing cell; ``counts`` (column -> missing
    cells, already computed by the caller) saves the pass over the table."""
    if not cols:
        return []
    if counts is None or any(c not in counts for c in cols):
        counts = null_counts(df, cols)
    return [c for c in cols if counts[c] > 0]


@nan_as_missing
def impute_numeric(df: DataFrame, method: str, order_by: list[str] | None = None,
                   cols: list[str] | None = None, exact: bool = True,
                   null_cells: dict[str, int] | None = None) -> DataFrame:
    """Fill numeric columns that have missing cells.

    ``median`` (linear-interpolated, exact by default) and ``mean`` turn
    the column into double; ``zero`` keeps the type; ``ffill``/``bfill``
    follow ``order_by``.  A column with no value at all stays as it is for
    median/mean (there is nothing to fill with).
    """
    cand = cols if cols is not None else numeric_columns(df)
    todo = columns_with_missing(df, cand, null_cells)
    if not todo:
        return df
    if method in ("ffill", "bfill"):
        if not order_by:
            raise ValueError("forward/backward fill needs order_by (Spark rows have no order)")
        return ordered_fill(df, todo, order_by, "forward" if method == "ffill" else "backward")
    if method == "zero":
        fills = {c: F.coalesce(q(c), F.lit(0).cast(df.schema[c].dataType)) for c in todo}
    elif method == "mean":
        st = column_stats(df, todo, m=F.avg)
        fills = {c: F.coalesce(q(c).cast("double"), F.lit(st[c]["m"]).cast("double")) for c in todo}
    elif method == "median":
        med = quantiles(df, todo, [0.5], exact=exact)
        fills = {c: F.coalesce(q(c).cast("double"), F.lit(med[(c, 0.5)]).cast("double")) for c in todo}
    else:
        raise ValueError(f"unknown numeric fill {method!r}")
    return df.select(*[fills[c].alias(c) if c in fills else q(c) for c in df.columns])


@nan_as_missing
def impute_categorical(df: DataFrame, method: str, order_by: list[str] | None = None,
                       cols: list[str] | None = None, label: str = UNKNOWN_LABEL,
                       null_cells: dict[str, int] | None = None) -> DataFrame:
    """Fill text columns that have missing cells: ``mode`` (smallest
    value on ties; all-null columns untouched), ``unknown`` (a label),
    ``ffill``/``bfill`` along ``order_by``."""
    cand = cols if cols is not None else categorical_columns(df)
    todo = columns_with_missing(df, cand, null_cells)
    if not todo:
        return df
    if method in ("ffill", "bfill"):
        if not order_by:
            raise ValueError("forward/backward fill needs order_by (Spark rows have no order)")
        return ordered_fill(df, todo, order_by, "forward" if method == "ffill" else "backward")
    if method == "unknown":
        fills = {c: F.coalesce(q(c), F.lit(label)) for c in todo}
    elif method == "mode":
        m = {r["column_name"]: r["value"] for r in top_k(df, todo, 1).collect()}
        fills = {c: F.coalesce(q(c), F.lit(m[c])) for c in todo if m.get(c) is not None}
    else:
        raise ValueError(f"unknown categorical fill {method!r}")
    return df.select(*[fills[c].alias(c) if c in fills else q(c) for c in df.columns])


# --- E1-E4 ------------------------------------------------------------------

def _clip(c: Column, lo, hi) -> Column:
    """Clip keeping NULL cells NULL (least/greatest would replace them with a
    bound); no-op when a bound is undefined (pandas clip with NaN)."""
    if lo is None or hi is None:
        return c
    return F.when(c.isNull(), c.cast("double")).otherwise(
        F.least(F.greatest(c.cast("double"), F.lit(float(lo))), F.lit(float(hi))))


@nan_as_missing
def std_bounds(df: DataFrame, cols: list[str]) -> dict[str, tuple]:
    """mean -+ 3 sample standard deviations per column (None if undefined)."""
    if not cols:
        return {}
    st = column_stats(df, cols, m=F.avg, s=F.stddev_samp)
    out = {}
    for c in cols:
        m, s = st[c]["m"], st[c]["s"]
        out[c] = (None, None) if m is None or s is None else (m - STD_FACTOR * s, m + STD_FACTOR * s)
    return out


@nan_as_missing
def iqr_bounds(df: DataFrame, cols: list[str], exact: bool = True) -> dict[str, tuple]:
    qs = quantiles(df, cols, [0.25, 0.75], exact=exact)
    out = {}
    for c in cols:
        q1, q3 = qs[(c, 0.25)], qs[(c, 0.75)]
        if q1 is None:
            out[c] = (None, None)
        else:
            iqr = q3 - q1
            out[c] = (q1 - IQR_FACTOR * iqr, q3 + IQR_FACTOR * iqr)
    return out


@nan_as_missing
def cap_outliers_with_count(df: DataFrame, method: str = "std3", exact: bool = True):
    """Clip every numeric column to its bounds; returns (df, number of
    cells outside the bounds before clipping)."""
    cols = numeric_columns(df)
    bounds = std_bounds(df, cols) if method == "std3" else iqr_bounds(df, cols, exact)
    cnt_exprs = [F.count(F.when((q(c) > F.lit(hi)) | (q(c) < F.lit(lo)), 1))
                 for c, (lo, hi) in bounds.items() if lo is not None]
    outside = 0
    if cnt_exprs:
        outside = df.agg(sum(cnt_exprs, F.lit(0)).alias("n")).first()["n"]
    capped = df.select(*[_clip(q(c), *bounds[c]).alias(c) if c in bounds and bounds[c][0] is not None
                         else q(c) for c in df.columns])
    return capped, outside


@nan_as_missing
def cap_outliers(df: DataFrame, method: str = "std3", exact: bool = True) -> DataFrame:
    return cap_outliers_with_count(df, method, exact)[0]


#: A row is set aside for the removal steps if a cell is NULL or lies so many standard deviations from its column's mean.
ASIDE_FACTOR = 2.5
#: Least share of a column's squared deviations that may be left after subtraction (so much of the precision is kept).
LEAST_LEFT = 1e-4


@nan_as_missing
def remove_outliers(df: DataFrame, sequential: bool = True) -> DataFrame:
    """Drop rows outside mean -+ 3 std, column after column with the
    statistics re-computed on the rows left (the reference's semantics).  A
    NULL cell fails the test, so its row goes, and a column without a defined
    std removes every row.  ``sequential=False`` takes all bounds from the
    input in one pass.

    The steps do not scan the table each: its moments come from one scan, the
    rows that any step may remove are set aside by a second one, and a step
    subtracts the removed rows among them from the moments
    (:func:`_sequential_bounds`)."""
    cols = numeric_columns(df)
    bounds = _sequential_bounds(df, cols) if sequential else std_bounds(df, cols)
    for c, (lo, hi) in bounds.items():
        df = df.where(_inside(c, lo, hi))
    return df


def _inside(c: str, lo: float | None, hi: float | None) -> Column:
    return F.lit(False) if lo is None else q(c).between(F.lit(lo), F.lit(hi))


def _sequential_bounds(df: DataFrame, cols: list[str]) -> dict[str, tuple]:
    """Bounds of each column over the rows that the columns before it leave; nothing after a column that removes every row.

    All removed rows are among those set aside as long as a column's bounds
    lie beyond ASIDE_FACTOR deviations of the first scan.  Where they do not,
    or where too little of the squared deviations is left to subtract from, the
    two scans are repeated on the rows that are left, which settles at least
    one column more."""
    out: dict[str, tuple] = {}
    while len(out) < len(cols):
        left = cols[len(out):]
        rows = df
        for c, (lo, hi) in out.items():
            rows = rows.where(_inside(c, lo, hi))
        st = column_stats(rows, left, n=F.count, m=F.avg, s=F.stddev_samp, low=F.min, high=F.max)
        for x in st.values():
            if x["s"] is not None and x["low"] == x["high"]:
                x["m"], x["s"] = x["low"], 0.0  # summed moments of equal values may be off by their last digit
        far = F.lit(False)
        for c in left:
            if st[c]["s"] is not None:
                far = far | q(c).isNull() | (F.abs(q(c).cast("double") - F.lit(st[c]["m"])) > F.lit(ASIDE_FACTOR * st[c]["s"]))
        aside = None
        kept = F.lit(True)  # of the rows set aside, those that the columns of this round leave
        for c in left:
            n, m, s = st[c]["n"], st[c]["m"], st[c]["s"]
            if s is not None and c != left[0]:
                if aside is None:
                    path = shared_scratch(df.sparkSession, "aside")
                    rows.where(far).select(*[q(x).cast("double").alias(f"x{i}") for i, x in enumerate(left)]).write.parquet(path)
                    aside = df.sparkSession.read.parquet(path)
                n, m, s = _without(aside.where(~kept), f"x{left.index(c)}", n, m, s)
                if s is None and n >= 2:
                    break
            if s is None:
                out[c] = (None, None)
                return out
            lo, hi = m - STD_FACTOR * s, m + STD_FACTOR * s
            if c != left[0] and (lo > st[c]["m"] - ASIDE_FACTOR * st[c]["s"] or hi < st[c]["m"] + ASIDE_FACTOR * st[c]["s"]):
                break
            out[c] = (lo, hi)
            if not math.isfinite(hi - lo):
                break  # infinite cells: the next scan sees what is left
            kept = kept & F.coalesce(F.col(f"x{left.index(c)}").between(F.lit(lo), F.lit(hi)), F.lit(False))
    return out


def _without(removed: DataFrame, c: str, n: int, m: float, s: float) -> tuple:
    """Count, mean and sample std of a column of n, m and s without the rows ``removed``; no std if it cannot be told from
    these (n of 2 or more), or if it is undefined (n below 2)."""
    if not math.isfinite(m) or not math.isfinite(s):
        return n, m, None
    d = F.col(c) - F.lit(m)
    r = removed.agg(F.count(c).alias("n"), F.coalesce(F.sum(d), F.lit(0.0)).alias("d"), F.coalesce(F.sum(d * d), F.lit(0.0)).alias("dd")).first()
    left = n - r["n"]
    if left < 2:
        return left, m, None
    squares = s * s * (n - 1)
    rest = squares - r["dd"] - r["d"] ** 2 / left
    if not math.isfinite(rest) or rest < LEAST_LEFT * squares:
        return left, m, None
    return left, m - r["d"] / left, math.sqrt(rest / (left - 1))


@nan_as_missing
def outlier_report(df: DataFrame, only_positive: bool = False, exact: bool = True) -> DataFrame:
    """IQR outliers per numeric column with values: count, % of non-null
    (2 dp), bounds (4 dp), smallest and largest outlier (4 dp)."""
    cols = numeric_columns(df)
    spark = df.sparkSession
    schema = ("column_name string, outlier_count bigint, outlier_percentage double, "
              "lower_bound double, upper_bound double, min_outlier double, max_outlier double")
    if not cols:
        return spark.createDataFrame([], schema)
    qs = quantiles(df, cols, [0.25, 0.75], exact=exact)
    present = [c for c in cols if qs[(c, 0.25)] is not None]
    if not present:
        return spark.createDataFrame([], schema)
    los = [qs[(c, 0.25)] - IQR_FACTOR * (qs[(c, 0.75)] - qs[(c, 0.25)]) for c in present]
    his = [qs[(c, 0.75)] + IQR_FACTOR * (qs[(c, 0.75)] - qs[(c, 0.25)]) for c in present]
    # one grouped aggregate over the unpivoted values (small buffer per column)
    pos, x = F.col("position"), F.col("x")
    lo, hi = pick(los, pos), pick(his, pos)
    out = (x < lo) | (x > hi)
    g = unpivot_numeric(df, present).groupBy("position").agg(
        F.count(F.when(out, 1)).alias("outlier_count"), F.count(x).alias("_n"),
        F.min(F.when(out, x)).alias("_mn"), F.max(F.when(out, x)).alias("_mx"))
    res = g.select(
        name_of(pos, present).alias("column_name"), "outlier_count",
        F.bround(F.col("outlier_count") / F.col("_n") * 100, 2).alias("outlier_percentage"),
        F.bround(lo, 4).alias("lower_bound"), F.bround(hi, 4).alias("upper_bound"),
        F.bround("_mn", 4).alias("min_outlier"), F.bround("_mx", 4).alias("max_outlier"))
    if only_positive:
        res = res.where(F.col("outlier_count") > 0)
    return res
