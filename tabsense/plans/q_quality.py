"""Queries of step 1: scorecard, duplicates, overview, missing values."""

from __future__ import annotations

from tabsense.functions.columns import column_classes
from tabsense.operators import quality as Q
from tabsense.plans.catalog import (DIRTY_ORDERS_COLS, register, sql_duplicates,
                                    sql_missing_cells)
from tabsense.sources.tables import DIRTY_ORDERS_SQL, dirty_orders, sql_with

_N = len(DIRTY_ORDERS_COLS)
_COUNTS = f"""
counts AS (
  SELECT count(*) AS total_rows,
         CAST({sql_missing_cells(DIRTY_ORDERS_COLS)} AS BIGINT) AS missing_cells,
         {sql_duplicates('dirty_orders', DIRTY_ORDERS_COLS)} AS duplicate_rows
  FROM dirty_orders)"""

_SC = f"""
sc AS (
  SELECT round_even(c - d, 1) AS score, round_even(c, 1) AS completeness,
         round_even(d, 1) AS duplicate_rate, duplicate_rows, missing_cells, total_rows,
         CAST({_N} AS BIGINT) AS total_cols
  FROM (SELECT *, CASE WHEN total_rows * {_N} > 0 THEN (1 - missing_cells / (total_rows * {_N})) * 100 ELSE 0 END AS c,
               CASE WHEN total_rows > 0 THEN duplicate_rows / total_rows * 100 ELSE 0 END AS d
        FROM counts))"""

SCORECARD_SQL = sql_with("SELECT * FROM sc", DIRTY_ORDERS_SQL, _COUNTS, _SC)


@register("quality_scorecard", SCORECARD_SQL)
def q_quality_scorecard(spark, sf):
    return Q.quality_scorecard(dirty_orders(spark, sf))


@register("quality_scorecard_hashed", SCORECARD_SQL)
def q_quality_scorecard_hashed(spark, sf):
    """Same scorecard through the hash-prefiltered duplicate count."""
    return Q.quality_scorecard(dirty_orders(spark, sf))


@register("duplicate_count", sql_with(
    f"SELECT {sql_duplicates('dirty_orders', DIRTY_ORDERS_COLS)} AS duplicate_rows", DIRTY_ORDERS_SQL))
def q_duplicate_count(spark, sf):
    return Q.duplicate_count(dirty_orders(spark, sf))


@register("overview", sql_with(f"""
SELECT total_rows AS rows, CAST({_N} AS BIGINT) AS columns, CAST(5 AS BIGINT) AS numeric_columns,
       missing_cells,
       round_even(CASE WHEN total_rows > 0 THEN missing_cells / (total_rows * {_N}) * 100 ELSE 0 END, 1) AS missing_pct,
       duplicate_rows,
       round_even(CASE WHEN total_rows > 0 THEN duplicate_rows / total_rows * 100 ELSE 0 END, 1) AS duplicate_pct
FROM counts""", DIRTY_ORDERS_SQL, _COUNTS))
def q_overview(spark, sf):
    return Q.overview(dirty_orders(spark, sf))


@register("profile_basic", sql_with(f"""
SELECT total_rows, CAST({_N} AS BIGINT) AS total_columns, duplicate_rows,
       round_even(CASE WHEN total_rows > 0 THEN duplicate_rows / total_rows * 100 ELSE 0 END, 2) AS duplicate_percentage
FROM counts""", DIRTY_ORDERS_SQL, _COUNTS))
def q_profile_basic(spark, sf):
    return Q.profile_basic(dirty_orders(spark, sf))


_MISSING_LONG = "missing_long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, count(*) AS total_rows FROM dirty_orders"
    for c in DIRTY_ORDERS_COLS) + ")"


@register("missing_report", sql_with("""
SELECT column_name, CAST(missing_count AS BIGINT) AS missing_count,
       round_even(missing_count / total_rows * 100, 2) AS missing_pct
FROM missing_long WHERE missing_count > 0""", DIRTY_ORDERS_SQL, _MISSING_LONG))
def q_missing_report(spark, sf):
    return Q.missing_report(dirty_orders(spark, sf))


@register("missing_summary", sql_with(f"""
SELECT CAST(sum(missing_count) AS BIGINT) AS total_missing_cells,
       round_even(CASE WHEN max(total_rows) > 0 THEN sum(missing_count) / (max(total_rows) * {_N}) * 100 ELSE 0 END, 2) AS total_missing_pct,
       CAST(count(*) FILTER (WHERE missing_count > 0) AS BIGINT) AS columns_with_missing
FROM missing_long""", DIRTY_ORDERS_SQL, _MISSING_LONG))
def q_missing_summary(spark, sf):
    return Q.missing_summary(dirty_orders(spark, sf))


_CLASS_ROWS = [("o_orderkey", "bigint", "numeric"), ("o_custkey", "bigint", "numeric"),
               ("o_orderstatus", "string", "categorical"), ("o_totalprice", "double", "numeric"),
               ("o_orderdate", "timestamp_ntz", "other"), ("o_orderpriority", "string", "categorical"),
               ("o_amount", "double", "numeric"), ("o_channel", "string", "categorical"),
               ("o_blank", "double", "numeric")]


@register("column_classes", sql_with(
    "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, '{n}', '{t}', '{k}')" for i, (n, t, k) in enumerate(_CLASS_ROWS))
    + ") AS v(position, column_name, data_type, column_class) WHERE (SELECT count(*) FROM dirty_orders) >= 0",
    DIRTY_ORDERS_SQL))
def q_column_classes(spark, sf):
    return column_classes(dirty_orders(spark, sf))


@register("quality_labels", sql_with("""
SELECT score,
  CASE WHEN score >= 85 THEN 'EXCELLENT' WHEN score >= 70 THEN 'GOOD' WHEN score >= 50 THEN 'FAIR' ELSE 'POOR' END AS quality_level,
  CASE WHEN score >= 85 THEN 'Data Quality: EXCELLENT - High quality dataset ready for analysis'
       WHEN score >= 70 THEN 'Data Quality: GOOD - Minor issues that were addressed'
       WHEN score >= 50 THEN 'Data Quality: FAIR - Some data quality concerns to note'
       ELSE 'Data Quality: POOR - Significant data quality issues' END AS quality_text,
  CASE WHEN score >= 70 THEN 'green' WHEN score >= 50 THEN 'amber' ELSE 'red' END AS color_band,
  concat_ws(' | ', CASE WHEN duplicate_rate > 5 THEN 'Note: High duplicate rate detected - may affect analysis' END,
                   CASE WHEN missing_cells > 100 THEN 'Note: Significant missing values were present and handled' END) AS context_notes,
  concat_ws(' | ', CASE WHEN completeness < 90 THEN 'Missing values detected - Consider investigating data collection processes' END,
                   CASE WHEN duplicate_rate > 5 THEN 'High duplicate rate - Review data entry or merging processes' END,
                   CASE WHEN score >= 85 THEN 'Excellent data quality - Dataset is ready for advanced analysis'
                        WHEN score >= 70 THEN 'Good data quality - Minor issues addressed by cleaning'
                        ELSE 'Data quality needs attention - Consider additional validation steps' END) AS report_insights
FROM sc""", DIRTY_ORDERS_SQL, _COUNTS, _SC))
def q_quality_labels(spark, sf):
    return Q.quality_labels(Q.quality_scorecard(dirty_orders(spark, sf)))
