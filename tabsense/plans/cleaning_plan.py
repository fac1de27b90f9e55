"""The cleaning plan as a whole (F1, F2) and its dry run.

Steps always run in this order, starting from the raw table:
duplicates -> rows with missing cells -> numeric fill -> categorical fill ->
outliers -> constant columns -> high-cardinality columns -> column names.

Statistics of a step are computed on the output of the steps before it.
Where several later jobs re-read an intermediate table that carries a
shuffle (after dedup, after forward/backward fills) the plan is cut with a
reliable checkpoint when the session names a checkpoint dir, so a lost
executor never forces that shuffle to be recomputed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.functions.columns import nan_as_missing, categorical_columns, numeric_columns, q
from tabsense.functions.stats import null_counts, rows_and_null_counts
from tabsense.operators import cleaning as C
from tabsense.operators.quality import row_hashes
from tabsense.session import materialize

NUMERIC_FILLS = ("median", "mean", "zero", "ffill", "bfill")
CATEGORICAL_FILLS = ("mode", "unknown", "ffill", "bfill")
OUTLIER_METHODS = ("std3", "iqr", "remove")

# Log wording of each effective step (thousands separated).
MSG_DUPLICATES = "Removed {n} duplicate rows"
MSG_MISSING_ROWS = "Removed {n} rows with missing values"
MSG_SPARSE_ROWS = "Removed {n} rows with >{pct}% missing values"
MSG_FILLED_NUMERIC = "Filled {n} missing numeric values"
MSG_FILLED_CATEGORICAL = "Filled {n} missing categorical values"
MSG_OUTLIERS = "Handled {n} outliers"
MSG_CONSTANT = "Removed {n} constant columns"
MSG_HIGH_CARD = "Removed {n} high-cardinality columns"
MSG_NAMES = "Standardized {n} column names"


@dataclass(frozen=True)
class CleanOptions:
    remove_duplicates: bool = True
    remove_missing_rows: bool = False
    missing_threshold: float = C.DEFAULT_MISSING_THRESHOLD
    fill_numeric: str | None = None
    fill_categorical: str | None = None
    order_by: tuple[str, ...] | None = None
    handle_outliers: bool = False
    outlier_method: str = "std3"
    remove_constant_columns: bool = False
    remove_high_cardinality: bool = False
    cardinality_threshold: int = C.DEFAULT_CARDINALITY
    standardize_names: bool = False
    exact: bool = True

    def validate(self):
        if self.fill_numeric not in (None,) + NUMERIC_FILLS:
            raise ValueError(f"fill_numeric must be one of {NUMERIC_FILLS}")
        if self.fill_categorical not in (None,) + CATEGORICAL_FILLS:
            raise ValueError(f"fill_categorical must be one of {CATEGORICAL_FILLS}")
        if self.outlier_method not in OUTLIER_METHODS:
            raise ValueError(f"outlier_method must be one of {OUTLIER_METHODS}")
        if not 0 <= self.missing_threshold <= 100:
            raise ValueError("missing_threshold is a percentage 0..100")


def _fmt(n: int) -> str:
    return f"{n:,}"


def _cut_if_ordered(df: DataFrame, method: str) -> DataFrame:
    """Forward/backward fills carry window shuffles in their lineage: cut it.
    Statistic fills (median, mean, zero, mode, unknown) are narrow
    projections with literal fill values; their lineage stays short."""
    return materialize(df) if method in ("ffill", "bfill") else df


@nan_as_missing
def clean(df: DataFrame, opts: CleanOptions = CleanOptions()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Run the cleaning steps; returns (clean table, log, summary).

    log: (step_no, step, affected, message) for each step that changed
    something; summary: one row with shapes before/after and rows removed.
    """
    opts.validate()
    spark = df.sparkSession
    log: list[tuple] = []
    cur = df
    rows_before = cur.count()
    cols_before = len(cur.columns)
    n = rows_before

    if opts.remove_duplicates:
        d = materialize(C.drop_duplicates(cur))
        nd = d.count()
        if n - nd > 0:
            log.append((1, "duplicates", n - nd, MSG_DUPLICATES.format(n=_fmt(n - nd))))
            cur, n = d, nd

    before = None   # missing cells per column before the fills, once known
    if opts.remove_missing_rows or opts.missing_threshold < 100:
        if opts.remove_missing_rows:
            f = C.drop_missing(cur)
            msg = MSG_MISSING_ROWS
        else:
            f = C.drop_sparse_rows(cur, opts.missing_threshold)
            msg = MSG_SPARSE_ROWS
        if opts.fill_numeric or opts.fill_categorical:
            # the fills need the missing cells of the kept rows: one pass
            # gives them together with the kept row count
            nf, before = rows_and_null_counts(f, numeric_columns(f) + categorical_columns(f))
        else:
            nf = f.count()
        if n - nf > 0:
            pct = opts.missing_threshold
            pct = int(pct) if float(pct).is_integer() else pct
            log.append((2, "missing_rows", n - nf, msg.format(n=_fmt(n - nf), pct=pct)))
            # a narrow filter over the checkpointed dedup output: nothing to cut
            cur, n = f, nf

    if opts.fill_numeric or opts.fill_categorical:
        nums, cats = numeric_columns(cur), categorical_columns(cur)
        order = list(opts.order_by or []) or None
        # missing cells of every column in one pass before the fills and one
        # after both: a numeric fill leaves text columns as they are and the
        # other way round, so each fill's count is a difference of the two
        if before is None:
            before = null_counts(cur, nums + cats)
        if opts.fill_numeric:
            cur = _cut_if_ordered(C.impute_numeric(cur, opts.fill_numeric, order, exact=opts.exact,
                                                   null_cells=before), opts.fill_numeric)
        if opts.fill_categorical:
            cur = _cut_if_ordered(C.impute_categorical(cur, opts.fill_categorical, order, null_cells=before),
                                  opts.fill_categorical)
        after = null_counts(cur, nums + cats)
        filled = sum(before[c] - after[c] for c in nums)
        if opts.fill_numeric and filled > 0:
            log.append((3, "numeric_fill", filled, MSG_FILLED_NUMERIC.format(n=_fmt(filled))))
        filled = sum(before[c] - after[c] for c in cats)
        if opts.fill_categorical and filled > 0:
            log.append((4, "categorical_fill", filled, MSG_FILLED_CATEGORICAL.format(n=_fmt(filled))))

    if opts.handle_outliers:
        if opts.outlier_method == "remove":
            r = C.remove_outliers(cur, sequential=True)
            nr = r.count()
            handled = n - nr
            cur, n = r, nr
        else:
            cur, handled = C.cap_outliers_with_count(cur, opts.outlier_method, opts.exact)
        if handled > 0:
            log.append((5, "outliers", handled, MSG_OUTLIERS.format(n=_fmt(handled))))

    if opts.remove_constant_columns:
        const = C.constant_columns(cur)
        if const:
            cur = cur.drop(*const)
            log.append((6, "constant_columns", len(const), MSG_CONSTANT.format(n=len(const))))

    if opts.remove_high_cardinality:
        hc = C.high_cardinality_columns(cur, opts.cardinality_threshold)
        if hc:
            cur = cur.drop(*hc)
            log.append((7, "high_cardinality_columns", len(hc), MSG_HIGH_CARD.format(n=len(hc))))

    if opts.standardize_names:
        k = len(cur.columns)
        cur = C.standardize_names(cur)
        log.append((8, "column_names", k, MSG_NAMES.format(n=k)))

    rows_after = n
    log_df = spark.createDataFrame(log, "step_no int, step string, affected bigint, message string")
    summary = spark.createDataFrame(
        [(rows_before, cols_before, rows_after, len(cur.columns), rows_before - rows_after,
          round((rows_before - rows_after) / rows_before * 100, 1) if rows_before else 0.0, len(log))],
        "rows_before bigint, cols_before bigint, rows_after bigint, cols_after bigint, "
        "rows_removed bigint, removed_pct double, steps bigint")
    return cur, log_df, summary


@nan_as_missing
def preview_cleaning(df: DataFrame, opts: CleanOptions = CleanOptions()) -> DataFrame:
    """What the first steps would remove or fill, without changing the
    table.  One lazy plan: distinct rows, known by a 128-bit hash, with their
    multiplicity and missing cells, then one aggregation yields every count."""
    opts.validate()
    cols = df.columns
    nums, cats = set(numeric_columns(df)), set(categorical_columns(df))
    missing = lambda some: sum((q(c).isNull().cast("long") for c in cols if c in some), F.lit(0).cast("long"))
    facts = {"_all": missing(set(cols)), "_num": missing(nums), "_cat": missing(cats)}
    grouped = (df.select(*row_hashes(df), *(v.alias(k) for k, v in facts.items()))
               .groupBy("_h1", "_h2", *facts).agg(F.count(F.lit(1)).alias("_n")))
    # per distinct row: how many copies survive dedup
    keep_n = F.lit(1) if opts.remove_duplicates else F.col("_n")
    if opts.remove_missing_rows:
        kept = F.col("_all") == 0
    elif opts.missing_threshold < 100:
        kept = F.col("_all") <= int(len(cols) * opts.missing_threshold / 100)
    else:
        kept = F.lit(True)
    kept_rows = F.when(kept, keep_n).otherwise(0)
    res = grouped.agg(
        F.sum("_n").cast("bigint").alias("rows_before"),
        F.sum(F.col("_n") - 1).cast("bigint").alias("duplicate_rows"),
        F.sum(keep_n).cast("bigint").alias("_after_dedup"),
        F.sum(kept_rows).cast("bigint").alias("rows_after"),
        F.sum(kept_rows * F.col("_num")).cast("bigint").alias("numeric_missing"),
        F.sum(kept_rows * F.col("_cat")).cast("bigint").alias("categorical_missing"),
    )
    rb, ra = F.coalesce(F.col("rows_before"), F.lit(0)), F.coalesce(F.col("rows_after"), F.lit(0))
    return res.select(
        rb.alias("rows_before"),
        (F.coalesce(F.col("duplicate_rows"), F.lit(0)) if opts.remove_duplicates else F.lit(0).cast("bigint"))
        .alias("duplicate_rows"),
        (F.coalesce(F.col("_after_dedup") - F.col("rows_after"), F.lit(0))).alias("missing_rows_removed"),
        (F.coalesce(F.col("numeric_missing"), F.lit(0)) if opts.fill_numeric else F.lit(0).cast("bigint"))
        .alias("numeric_to_fill"),
        (F.coalesce(F.col("categorical_missing"), F.lit(0)) if opts.fill_categorical else F.lit(0).cast("bigint"))
        .alias("categorical_to_fill"),
        (rb - ra).alias("rows_removed"),
        F.bround(F.when(rb > 0, (rb - ra) / rb * 100).otherwise(0.0), 1).alias("removed_pct"),
    )
