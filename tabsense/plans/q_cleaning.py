"""Queries of steps 2-4: row/column cleaning, imputation, outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.functions.columns import q
from tabsense.operators import cleaning as C
from tabsense.plans.catalog import (DIRTY_LINEITEM_COLS, DIRTY_LINEITEM_NUMERIC, sql_missing_cells,
                                    DIRTY_ORDERS_COLS, DIRTY_ORDERS_NUMERIC, register)
from tabsense.sources.tables import (DIRTY_LINEITEM_SQL, DIRTY_ORDERS_SQL, GAPPY_EVENTS_SQL,
                                     dirty_lineitem, dirty_orders, gappy_events, sql_with, table)


def round_doubles(df: DataFrame, digits: int = 4) -> DataFrame:
    """Presentation rounding (half-even) of floating columns for value hashes."""
    return df.select(*[F.bround(q(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else q(f.name)
                       for f in df.schema.fields])


def _sel(cols, override=None, rnd=None):
    override = override or {}
    out = []
    for c in cols:
        e = override.get(c, c)
        if rnd and c in rnd:
            e = f"round_even(CAST({e} AS DOUBLE), 4)"
        out.append(f"{e} AS {c}")
    return ", ".join(out)


_DO_DOUBLES = ["o_totalprice", "o_amount", "o_blank"]

# --- step 2 -----------------------------------------------------------------


@register("drop_duplicates", sql_with("SELECT DISTINCT * FROM dirty_orders", DIRTY_ORDERS_SQL))
def q_drop_duplicates(spark, sf):
    return C.drop_duplicates(dirty_orders(spark, sf))


@register("drop_any_missing", sql_with(
    "SELECT * FROM dirty_lineitem WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in DIRTY_LINEITEM_COLS),
    DIRTY_LINEITEM_SQL))
def q_drop_any_missing(spark, sf):
    return C.drop_missing(dirty_lineitem(spark, sf))


@register("drop_sparse_rows", sql_with(
    "SELECT * FROM dirty_orders WHERE (" + " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in DIRTY_ORDERS_COLS)
    + ") <= 2", DIRTY_ORDERS_SQL))
def q_drop_sparse_rows(spark, sf):
    # 30 % of 9 columns -> at most int(2.7) = 2 missing cells per row
    return C.drop_sparse_rows(dirty_orders(spark, sf), 30)


@register("drop_constant_columns", sql_with(
    "SELECT " + ", ".join(c for c in DIRTY_ORDERS_COLS if c != "o_channel") + " FROM dirty_orders",
    DIRTY_ORDERS_SQL))
def q_drop_constant_columns(spark, sf):
    return C.drop_constant_columns(dirty_orders(spark, sf))


@register("drop_high_cardinality",
          "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_drop_high_cardinality(spark, sf):
    return C.drop_high_cardinality(table(spark, sf, "customer"), 100)


_MESSY = [(" Order Key", "o_orderkey", "order_key"), ("Cust-Key", "o_custkey", "cust_key"),
          ("Order Status ", "o_orderstatus", "order_status"), ("TOTAL price", "o_totalprice", "total_price"),
          ("order-date", "o_orderdate", "order_date"), ("Order_Priority", "o_orderpriority", "order_priority"),
          ("order status", "o_orderstatus", "order_status_2")]


@register("standardize_names", "SELECT " + ", ".join(f"{src} AS {dst}" for _, src, dst in _MESSY) + " FROM orders")
def q_standardize_names(spark, sf):
    o = table(spark, sf, "orders")
    messy = o.select(*[q(src).alias(name) for name, src, _ in _MESSY])
    return C.standardize_names(messy)


@register("drop_index_columns", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def q_drop_index_columns(spark, sf):
    o = table(spark, sf, "orders")
    framed = o.select(F.col("o_orderkey").alias("index"), F.col("o_custkey").alias("Unnamed: 0"),
                      "o_orderkey", "o_orderstatus", "o_totalprice")
    return C.drop_index_columns(framed)


@register("training_rows", sql_with(
    "SELECT l_quantity, l_discount, l_linestatus, l_returnflag FROM dirty_lineitem WHERE l_returnflag IS NOT NULL",
    DIRTY_LINEITEM_SQL))
def q_training_rows(spark, sf):
    return C.select_features(dirty_lineitem(spark, sf), "l_returnflag",
                             ["l_quantity", "l_discount", "l_linestatus"])


# --- step 3 -----------------------------------------------------------------

def _fill_sql(agg: str) -> str:
    """``agg`` is a template with ``{c}`` for the column."""
    return sql_with("SELECT " + _sel(DIRTY_ORDERS_COLS, {
        c: f"coalesce({c}, (SELECT {agg.format(c=c)} FROM dirty_orders))" for c in ("o_totalprice", "o_blank")
    }, _DO_DOUBLES) + " FROM dirty_orders", DIRTY_ORDERS_SQL)


@register("impute_median", _fill_sql("quantile_cont({c}, 0.5)"))
def q_impute_median(spark, sf):
    return round_doubles(C.impute_numeric(dirty_orders(spark, sf), "median"))


@register("impute_mean", _fill_sql("avg({c})"))
def q_impute_mean(spark, sf):
    return round_doubles(C.impute_numeric(dirty_orders(spark, sf), "mean"))


@register("impute_zero", sql_with("SELECT " + _sel(DIRTY_ORDERS_COLS, {
    "o_totalprice": "coalesce(o_totalprice, 0)", "o_blank": "coalesce(o_blank, 0)"}, _DO_DOUBLES)
    + " FROM dirty_orders", DIRTY_ORDERS_SQL))
def q_impute_zero(spark, sf):
    return round_doubles(C.impute_numeric(dirty_orders(spark, sf), "zero"))


_EV = ["event_id", "user_id", "value", "event_type"]
_FWD = "OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_BWD = "OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@register("impute_ffill", sql_with("SELECT " + _sel(_EV, {
    "value": f"last_value(value IGNORE NULLS) {_FWD}"}) + " FROM gappy_events", GAPPY_EVENTS_SQL))
def q_impute_ffill(spark, sf):
    return C.impute_numeric(gappy_events(spark, sf), "ffill", order_by=["event_id"])


@register("impute_bfill", sql_with("SELECT " + _sel(_EV, {
    "value": f"first_value(value IGNORE NULLS) {_BWD}"}) + " FROM gappy_events", GAPPY_EVENTS_SQL))
def q_impute_bfill(spark, sf):
    return C.impute_numeric(gappy_events(spark, sf), "bfill", order_by=["event_id"])


@register("impute_cat_ffill", sql_with("SELECT " + _sel(_EV, {
    "event_type": f"last_value(event_type IGNORE NULLS) {_FWD}"}) + " FROM gappy_events", GAPPY_EVENTS_SQL))
def q_impute_cat_ffill(spark, sf):
    return C.impute_categorical(gappy_events(spark, sf), "ffill", order_by=["event_id"])


@register("impute_cat_bfill", sql_with("SELECT " + _sel(_EV, {
    "event_type": f"first_value(event_type IGNORE NULLS) {_BWD}"}) + " FROM gappy_events", GAPPY_EVENTS_SQL))
def q_impute_cat_bfill(spark, sf):
    return C.impute_categorical(gappy_events(spark, sf), "bfill", order_by=["event_id"])


def _mode_sql(c):
    return (f"(SELECT {c} FROM dirty_orders WHERE {c} IS NOT NULL GROUP BY {c} "
            f"ORDER BY count(*) DESC, {c} ASC LIMIT 1)")


@register("impute_mode", sql_with("SELECT " + _sel(DIRTY_ORDERS_COLS, {
    "o_orderstatus": f"coalesce(o_orderstatus, {_mode_sql('o_orderstatus')})",
    "o_orderpriority": f"coalesce(o_orderpriority, {_mode_sql('o_orderpriority')})"}, _DO_DOUBLES)
    + " FROM dirty_orders", DIRTY_ORDERS_SQL))
def q_impute_mode(spark, sf):
    return round_doubles(C.impute_categorical(dirty_orders(spark, sf), "mode"))


@register("impute_unknown", sql_with("SELECT " + _sel(DIRTY_ORDERS_COLS, {
    "o_orderstatus": "coalesce(o_orderstatus, 'Unknown')",
    "o_orderpriority": "coalesce(o_orderpriority, 'Unknown')"}, _DO_DOUBLES)
    + " FROM dirty_orders", DIRTY_ORDERS_SQL))
def q_impute_unknown(spark, sf):
    return round_doubles(C.impute_categorical(dirty_orders(spark, sf), "unknown"))


# --- step 4 -----------------------------------------------------------------

def _cap_sql(bounds_cte: str) -> str:
    over = {}
    for c in DIRTY_ORDERS_NUMERIC:
        over[c] = (f"CASE WHEN {c} IS NULL OR (SELECT lo_{c} FROM b) IS NULL THEN {c} "
                   f"ELSE least(greatest({c}, (SELECT lo_{c} FROM b)), (SELECT hi_{c} FROM b)) END")
    return sql_with("SELECT " + _sel(DIRTY_ORDERS_COLS, over, DIRTY_ORDERS_NUMERIC) + " FROM dirty_orders",
                    DIRTY_ORDERS_SQL, bounds_cte)


_STD_B = "b AS (SELECT " + ", ".join(
    f"avg({c}) - 3 * stddev_samp({c}) AS lo_{c}, avg({c}) + 3 * stddev_samp({c}) AS hi_{c}"
    for c in DIRTY_ORDERS_NUMERIC) + " FROM dirty_orders)"
_IQR_B = "b AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo_{c}, "
    f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi_{c}"
    for c in DIRTY_ORDERS_NUMERIC) + " FROM dirty_orders)"


@register("cap_std3", _cap_sql(_STD_B))
def q_cap_std3(spark, sf):
    return round_doubles(C.cap_outliers(dirty_orders(spark, sf), "std3"))


@register("cap_iqr", _cap_sql(_IQR_B))
def q_cap_iqr(spark, sf):
    return round_doubles(C.cap_outliers(dirty_orders(spark, sf), "iqr"))


def _remove_sql() -> str:
    ctes = [DIRTY_LINEITEM_SQL, "r0 AS (SELECT * FROM dirty_lineitem)"]
    for i, c in enumerate(DIRTY_LINEITEM_NUMERIC):
        ctes.append(f"s{i} AS (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM r{i})")
        ctes.append(f"r{i + 1} AS (SELECT r{i}.* FROM r{i}, s{i} "
                    f"WHERE {c} BETWEEN m - 3 * s AND m + 3 * s)")
    n = len(DIRTY_LINEITEM_NUMERIC)
    return sql_with(f"SELECT * FROM r{n}", *ctes)


@register("remove_outliers", _remove_sql())
def q_remove_outliers(spark, sf):
    return C.remove_outliers(dirty_lineitem(spark, sf), sequential=True)


def _outlier_report_sql() -> str:
    parts = []
    for c in DIRTY_ORDERS_NUMERIC:
        parts.append(f"""
SELECT '{c}' AS column_name, CAST(count(*) FILTER (WHERE x < lo OR x > hi) AS BIGINT) AS outlier_count,
  round_even(count(*) FILTER (WHERE x < lo OR x > hi) / count(x) * 100, 2) AS outlier_percentage,
  round_even(any_value(lo), 4) AS lower_bound, round_even(any_value(hi), 4) AS upper_bound,
  round_even(min(x) FILTER (WHERE x < lo OR x > hi), 4) AS min_outlier,
  round_even(max(x) FILTER (WHERE x < lo OR x > hi), 4) AS max_outlier
FROM (SELECT CAST({c} AS DOUBLE) AS x, lo, hi FROM dirty_orders,
      (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo,
              quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi
       FROM dirty_orders)) t
WHERE x IS NOT NULL HAVING count(x) > 0""")
    return sql_with(" UNION ALL ".join(parts), DIRTY_ORDERS_SQL)


@register("outlier_report", _outlier_report_sql())
def q_outlier_report(spark, sf):
    return C.outlier_report(dirty_orders(spark, sf))


# --- cleaning plan (F1, F2, B11) --------------------------------------------

from tabsense.plans.cleaning_plan import CleanOptions, clean, preview_cleaning  # noqa: E402

CLEAN_OPTS = CleanOptions(remove_duplicates=True, missing_threshold=30, fill_numeric="median",
                          fill_categorical="mode", handle_outliers=True, outlier_method="std3",
                          remove_constant_columns=True)

_NUM = DIRTY_ORDERS_NUMERIC
_CAT = ["o_orderstatus", "o_orderpriority", "o_channel"]


def _clean_ctes() -> list[str]:
    nulls = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in DIRTY_ORDERS_COLS)
    ctes = [DIRTY_ORDERS_SQL,
            "d AS (SELECT DISTINCT * FROM dirty_orders)",
            f"f AS (SELECT * FROM d WHERE ({nulls}) <= 2)"]
    med = {c: f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont({c}, 0.5) FROM f))"
           for c in ("o_totalprice", "o_blank")}
    ctes.append("n AS (SELECT " + _sel(DIRTY_ORDERS_COLS, med) + " FROM f)")
    modes = {c: f"coalesce({c}, (SELECT {c} FROM n WHERE {c} IS NOT NULL GROUP BY {c} "
                f"ORDER BY count(*) DESC, {c} LIMIT 1))" for c in ("o_orderstatus", "o_orderpriority")}
    ctes.append("c AS (SELECT " + _sel(DIRTY_ORDERS_COLS, modes) + " FROM n)")
    ctes.append("b AS (SELECT " + ", ".join(
        f"avg({c}) - 3 * stddev_samp({c}) AS lo_{c}, avg({c}) + 3 * stddev_samp({c}) AS hi_{c}" for c in _NUM)
        + " FROM c)")
    capped = {c: (f"CASE WHEN {c} IS NULL OR (SELECT lo_{c} FROM b) IS NULL THEN CAST({c} AS DOUBLE) "
                  f"ELSE least(greatest({c}, (SELECT lo_{c} FROM b)), (SELECT hi_{c} FROM b)) END") for c in _NUM}
    ctes.append("o AS (SELECT " + _sel(DIRTY_ORDERS_COLS, capped) + " FROM c)")
    return ctes


_CLEAN_COLS = [c for c in DIRTY_ORDERS_COLS if c != "o_channel"]


@register("clean_table", sql_with("SELECT " + _sel(_CLEAN_COLS, None, _NUM) + " FROM o", *_clean_ctes()))
def q_clean_table(spark, sf):
    out, _, _ = clean(dirty_orders(spark, sf), CLEAN_OPTS)
    return round_doubles(out)


def _cnt_nulls(t, cols):
    return " + ".join(f"(SELECT count(*) - count({c}) FROM {t})" for c in cols)


_OUTSIDE = " + ".join(
    f"(SELECT count(*) FROM c, b WHERE {c} > hi_{c} OR {c} < lo_{c})" for c in _NUM)
_LOG_SQL = sql_with(f"""
SELECT * FROM (
  SELECT 1 AS step_no, 'duplicates' AS step, (SELECT count(*) FROM dirty_orders) - (SELECT count(*) FROM d) AS affected
  UNION ALL SELECT 2, 'missing_rows', (SELECT count(*) FROM d) - (SELECT count(*) FROM f)
  UNION ALL SELECT 3, 'numeric_fill', ({_cnt_nulls('f', _NUM)}) - ({_cnt_nulls('n', _NUM)})
  UNION ALL SELECT 4, 'categorical_fill', ({_cnt_nulls('n', _CAT)}) - ({_cnt_nulls('c', _CAT)})
  UNION ALL SELECT 5, 'outliers', {_OUTSIDE}
  UNION ALL SELECT 6, 'constant_columns', 1)
""", *_clean_ctes())
_LOG_SQL = sql_with(f"""
SELECT CAST(step_no AS INTEGER) AS step_no, step, CAST(affected AS BIGINT) AS affected,
  CASE step
    WHEN 'duplicates' THEN 'Removed ' || format('{{:,}}', affected) || ' duplicate rows'
    WHEN 'missing_rows' THEN 'Removed ' || format('{{:,}}', affected) || ' rows with >30% missing values'
    WHEN 'numeric_fill' THEN 'Filled ' || format('{{:,}}', affected) || ' missing numeric values'
    WHEN 'categorical_fill' THEN 'Filled ' || format('{{:,}}', affected) || ' missing categorical values'
    WHEN 'outliers' THEN 'Handled ' || format('{{:,}}', affected) || ' outliers'
    WHEN 'constant_columns' THEN 'Removed ' || affected || ' constant columns' END AS message
FROM steps WHERE affected > 0""", *_clean_ctes(), "steps AS (" + _LOG_SQL.split("\nSELECT * FROM (", 1)[1].rsplit(")", 1)[0] + ")")


@register("cleaning_report", _LOG_SQL)
def q_cleaning_report(spark, sf):
    _, log, _ = clean(dirty_orders(spark, sf), CLEAN_OPTS)
    return log


@register("cleaning_summary", sql_with("""
SELECT (SELECT count(*) FROM dirty_orders) AS rows_before, CAST(9 AS BIGINT) AS cols_before,
       (SELECT count(*) FROM o) AS rows_after, CAST(8 AS BIGINT) AS cols_after,
       (SELECT count(*) FROM dirty_orders) - (SELECT count(*) FROM o) AS rows_removed,
       round_even(((SELECT count(*) FROM dirty_orders) - (SELECT count(*) FROM o)) / (SELECT count(*) FROM dirty_orders) * 100, 1) AS removed_pct,
       CAST(6 AS BIGINT) AS steps""", *_clean_ctes()))
def q_cleaning_summary(spark, sf):
    _, _, summary = clean(dirty_orders(spark, sf), CLEAN_OPTS)
    return summary


_PREVIEW_OPTS = CleanOptions(remove_duplicates=True, missing_threshold=30, fill_numeric="median",
                             fill_categorical="mode")


@register("cleaning_preview", sql_with(f"""
SELECT (SELECT count(*) FROM dirty_orders) AS rows_before,
       (SELECT count(*) FROM dirty_orders) - (SELECT count(*) FROM d) AS duplicate_rows,
       (SELECT count(*) FROM d) - (SELECT count(*) FROM f) AS missing_rows_removed,
       CAST({_cnt_nulls('f', _NUM)} AS BIGINT) AS numeric_to_fill,
       CAST({_cnt_nulls('f', _CAT)} AS BIGINT) AS categorical_to_fill,
       (SELECT count(*) FROM dirty_orders) - (SELECT count(*) FROM f) AS rows_removed,
       round_even(((SELECT count(*) FROM dirty_orders) - (SELECT count(*) FROM f)) / (SELECT count(*) FROM dirty_orders) * 100, 1) AS removed_pct""",
    *_clean_ctes()[:3]))
def q_cleaning_preview(spark, sf):
    return preview_cleaning(dirty_orders(spark, sf), _PREVIEW_OPTS)


# --- M2: Markdown report frame ---------------------------------------------------

from tabsense.operators.quality import quality_scorecard  # noqa: E402
from tabsense.operators.reporting import report_frame  # noqa: E402

_TS = "2024-01-01 00:00:00"


def _report_sql() -> str:
    from tabsense.plans.q_quality import _COUNTS, _SC
    n = len(DIRTY_ORDERS_COLS)
    steps = _LOG_SQL.split("\nSELECT CAST(step_no AS INTEGER) AS step_no", 1)
    log_ctes = steps[0]  # WITH ... CTE list incl. steps
    body = f"""
, qsc AS (SELECT * FROM sc),
lg AS (SELECT step_no, CASE step
    WHEN 'duplicates' THEN 'Removed ' || format('{{:,}}', affected) || ' duplicate rows'
    WHEN 'missing_rows' THEN 'Removed ' || format('{{:,}}', affected) || ' rows with >30% missing values'
    WHEN 'numeric_fill' THEN 'Filled ' || format('{{:,}}', affected) || ' missing numeric values'
    WHEN 'categorical_fill' THEN 'Filled ' || format('{{:,}}', affected) || ' missing categorical values'
    WHEN 'outliers' THEN 'Handled ' || format('{{:,}}', affected) || ' outliers'
    WHEN 'constant_columns' THEN 'Removed ' || affected || ' constant columns' END AS message FROM steps WHERE affected > 0),
base AS (SELECT count(*) AS rows, {sql_missing_cells(DIRTY_ORDERS_COLS)} AS missing FROM dirty_orders),
rb AS (SELECT (SELECT count(*) FROM dirty_orders) AS rows_before, (SELECT count(*) FROM o) AS rows_after)
SELECT CAST(section AS INTEGER) AS section, CAST(line_no AS INTEGER) AS line_no, line FROM (
  SELECT 0 AS section, 0 AS line_no, '# Data Analysis Report' AS line
  UNION ALL SELECT 0, 1, '' UNION ALL SELECT 0, 2, '**File:** `dirty_orders`  '
  UNION ALL SELECT 0, 3, '**Generated:** {_TS}  '
  UNION ALL SELECT 0, 4, '**Dataset Size:** ' || format('{{:,}}', rows) || ' rows × {n} columns' FROM base
  UNION ALL SELECT 0, 5, '' UNION ALL SELECT 0, 6, '---' UNION ALL SELECT 0, 7, ''
  UNION ALL SELECT 1, 100, '## 1. Dataset Overview' UNION ALL SELECT 1, 101, ''
  UNION ALL SELECT 1, 102, '| Metric | Value |' UNION ALL SELECT 1, 103, '|--------|-------|'
  UNION ALL SELECT 1, 104, '| Total Rows | **' || format('{{:,}}', rows) || '** |' FROM base
  UNION ALL SELECT 1, 105, '| Total Columns | **{n}** |' UNION ALL SELECT 1, 106, '| Numeric Columns | **5** |'
  UNION ALL SELECT 1, 107, '| Categorical Columns | **3** |'
  UNION ALL SELECT 1, 108, '| Missing Cells | **' || format('{{:,}}', missing) || '** |' FROM base
  UNION ALL SELECT 1, 109, ''
  UNION ALL SELECT 2, 200, '## 2. Data Quality Assessment' UNION ALL SELECT 2, 201, ''
  UNION ALL SELECT 2, 202, '### Overall Quality Score: **' || CAST(score AS VARCHAR) || '/100**' FROM qsc
  UNION ALL SELECT 2, 203, '' UNION ALL SELECT 2, 204, '| Dimension | Score |' UNION ALL SELECT 2, 205, '|-----------|-------|'
  UNION ALL SELECT 2, 206, '| Completeness | ' || CAST(completeness AS VARCHAR) || '% |' FROM qsc
  UNION ALL SELECT 2, 207, '| Duplicate Rate | ' || CAST(duplicate_rate AS VARCHAR) || '% |' FROM qsc
  UNION ALL SELECT 2, 208, ''
  UNION ALL SELECT 3, 300, '## 3. Data Cleaning Summary' UNION ALL SELECT 3, 301, ''
  UNION ALL SELECT 3, 302, '- **Rows before cleaning:** ' || format('{{:,}}', rows_before) FROM rb
  UNION ALL SELECT 3, 303, '- **Rows after cleaning:** ' || format('{{:,}}', rows_after) FROM rb
  UNION ALL SELECT 3, 304, '- **Rows removed:** ' || format('{{:,}}', rows_before - rows_after) FROM rb
  UNION ALL SELECT 3, 305, ''
  UNION ALL SELECT 3, 306, '### Cleaning Operations Performed:' UNION ALL SELECT 3, 307, ''
  UNION ALL SELECT 3, 399, ''
  UNION ALL SELECT 3, 310 + step_no, '- ' || message FROM lg
  UNION ALL SELECT 9, 900, '---' UNION ALL SELECT 9, 901, '*Report generated by tabsense · {_TS}*')"""
    return log_ctes + ",\n" + _COUNTS.strip() + ",\n" + _SC.strip() + body


@register("report_frame", _report_sql())
def q_report_frame(spark, sf):
    d = dirty_orders(spark, sf)
    _, log, summary = clean(d, CLEAN_OPTS)
    return report_frame(d, "dirty_orders", _TS, quality_scorecard(d), summary, log)


# --- NaN as missing; fills along a hot, partly missing text key -------------------

from tabsense.operators.quality import missing_report  # noqa: E402
from tabsense.sources.tables import HOT_EVENTS_SQL, NAN_EVENTS_SQL, hot_events, nan_events  # noqa: E402


@register("missing_report_nan", sql_with("""
SELECT 'value' AS column_name, count(*) - count(value) AS missing_count,
  round_even((count(*) - count(value)) / count(*) * 100, 2) AS missing_pct FROM nan_events""", NAN_EVENTS_SQL))
def q_missing_report_nan(spark, sf):
    return missing_report(nan_events(spark, sf))


@register("impute_mean_nan", sql_with("""
SELECT event_id, round_even_sig(coalesce(value, (SELECT avg(value) FROM nan_events)), 6) AS value, event_type FROM nan_events""", NAN_EVENTS_SQL))
def q_impute_mean_nan(spark, sf):
    from tabsense.functions.stats import round_sig
    return C.impute_numeric(nan_events(spark, sf), "mean", cols=["value"]).select("event_id", round_sig("value", 6).alias("value"), "event_type")


_HOT_ORDER = "ORDER BY k ASC NULLS FIRST, event_id"


@register("impute_ffill_hot_key", sql_with(f"""
SELECT k, event_id, last_value(value IGNORE NULLS) OVER ({_HOT_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
FROM hot_events""", GAPPY_EVENTS_SQL, HOT_EVENTS_SQL))
def q_impute_ffill_hot_key(spark, sf):
    return C.impute_numeric(hot_events(spark, sf), "ffill", order_by=["k", "event_id"], cols=["value"])


@register("impute_bfill_hot_key", sql_with(f"""
SELECT k, event_id, first_value(value IGNORE NULLS) OVER ({_HOT_ORDER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value
FROM hot_events""", GAPPY_EVENTS_SQL, HOT_EVENTS_SQL))
def q_impute_bfill_hot_key(spark, sf):
    return C.impute_numeric(hot_events(spark, sf), "bfill", order_by=["k", "event_id"], cols=["value"])
