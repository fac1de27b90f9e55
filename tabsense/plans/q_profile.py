"""Queries of step 5 and the documented-only profile measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsense.operators import profile as P
from tabsense.plans.catalog import (DIRTY_LINEITEM_NUMERIC, DIRTY_ORDERS_COLS, register,
                                    sql_duplicates, sql_missing_cells)
from tabsense.session import shared_scratch
from tabsense.sources.sinks import write_report
from tabsense.sources.tables import (DIRTY_LINEITEM_SQL, DIRTY_ORDERS_SQL, dirty_lineitem,
                                     dirty_orders, sql_with, table)

_DO_NUM_PRESENT = ["o_orderkey", "o_custkey", "o_totalprice", "o_amount"]
_DO_CAT = ["o_orderstatus", "o_orderpriority", "o_channel"]


def _skew_sql(x, d):
    return (f"round_even(CASE WHEN count({x}) < 3 THEN NULL WHEN stddev_pop({x}) = 0 THEN 0 "
            f"ELSE skewness({x}) END, {d})")


def _kurt_sql(x, d):
    return (f"round_even(CASE WHEN count({x}) < 4 THEN NULL WHEN stddev_pop({x}) = 0 THEN 0 "
            f"ELSE kurtosis({x}) END, {d})")


def _profile_numeric_sql():
    parts = []
    for c in _DO_NUM_PRESENT:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""
SELECT '{c}' AS column_name, count({c}) AS count, count(*) - count({c}) AS missing,
  round_even((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct,
  round_even_sig(avg({x}), 4) AS mean, round_even_sig(quantile_cont({x}, 0.5), 4) AS median,
  round_even_sig(stddev_samp({x}), 4) AS std, round_even_sig(var_samp({x}), 4) AS var,
  round_even_sig(min({x}), 4) AS min, round_even_sig(max({x}), 4) AS max,
  round_even_sig(max({x}) - min({x}), 4) AS range,
  round_even_sig(quantile_cont({x}, 0.25), 4) AS q1, round_even_sig(quantile_cont({x}, 0.75), 4) AS q3,
  round_even_sig(quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25), 4) AS iqr,
  {_skew_sql(x, 4)} AS skewness, {_kurt_sql(x, 4)} AS kurtosis,
  count(DISTINCT {c}) AS unique_values,
  count(*) FILTER (WHERE {x} = 0) AS zero_count, count(*) FILTER (WHERE {x} < 0) AS negative_count,
  count(*) FILTER (WHERE {x} > 0) AS positive_count
FROM dirty_orders""")
    return sql_with(" UNION ALL ".join(parts), DIRTY_ORDERS_SQL)


@register("profile_numeric", _profile_numeric_sql())
def q_profile_numeric(spark, sf):
    return P.profile_numeric(dirty_orders(spark, sf))


def _describe_sql():
    parts = []
    for c in DIRTY_LINEITEM_NUMERIC:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""
SELECT '{c}' AS column_name, CAST(count({c}) AS DOUBLE) AS count, round_even_sig(avg({x}), 3) AS mean,
  round_even_sig(stddev_samp({x}), 3) AS std, round_even_sig(min({x}), 3) AS min,
  round_even_sig(quantile_cont({x}, 0.25), 3) AS p25, round_even_sig(quantile_cont({x}, 0.5), 3) AS p50,
  round_even_sig(quantile_cont({x}, 0.75), 3) AS p75, round_even_sig(max({x}), 3) AS max,
  {_skew_sql(x, 3)} AS skewness, {_kurt_sql(x, 3)} AS kurtosis,
  CAST(count(*) - count({c}) AS DOUBLE) AS missing,
  round_even(round_even((count(*) - count({c})) / count(*) * 100, 2), 3) AS missing_pct
FROM dirty_lineitem""")
    return sql_with(" UNION ALL ".join(parts), DIRTY_LINEITEM_SQL)


@register("describe_numeric", _describe_sql())
def q_describe_numeric(spark, sf):
    return P.describe_numeric(dirty_lineitem(spark, sf))


def _profile_categorical_sql():
    parts = []
    for c in _DO_CAT:
        parts.append(f"""
SELECT '{c}' AS column_name, count({c}) AS count, count(*) - count({c}) AS missing,
  round_even((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct,
  (SELECT count(DISTINCT {c}) FROM dirty_orders) AS unique_values,
  (SELECT v FROM vc WHERE col = '{c}' AND rk = 1) AS most_frequent,
  (SELECT n FROM vc WHERE col = '{c}' AND rk = 1) AS most_frequent_count,
  round_even((SELECT n FROM vc WHERE col = '{c}' AND rk = 1) / count({c}) * 100, 2) AS most_frequent_pct,
  (SELECT string_agg(v || '=' || CAST(n AS VARCHAR), '; ' ORDER BY rk) FROM vc WHERE col = '{c}' AND rk <= 5) AS top_values
FROM dirty_orders HAVING count({c}) > 0""")
    vc = "vc AS (SELECT col, v, n, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) AS rk FROM (" + \
        " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS v, count(*) AS n FROM dirty_orders WHERE {c} IS NOT NULL "
                           f"GROUP BY {c}" for c in _DO_CAT) + "))"
    return sql_with(" UNION ALL ".join(parts), DIRTY_ORDERS_SQL, vc)


@register("profile_categorical", _profile_categorical_sql())
def q_profile_categorical(spark, sf):
    return P.profile_categorical(dirty_orders(spark, sf))


_TOPV = ["p_brand", "p_type"]


@register("top_values", """
SELECT column_name, CAST(rank AS INTEGER) AS rank, value, count FROM (
  SELECT column_name, value, count, row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS rank
  FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS count FROM part "
    f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in _TOPV) + ")) WHERE rank <= 10")
def q_top_values(spark, sf):
    return P.top_values(table(spark, sf, "part"), _TOPV, 10)


@register("frequency_table", """
SELECT CAST(rank AS INTEGER) AS rank, value, count, round_even(count / (SELECT count(*) FROM part) * 100, 2) AS percentage
FROM (SELECT CAST(p_type AS VARCHAR) AS value, count(*) AS count,
             row_number() OVER (ORDER BY count(*) DESC, CAST(p_type AS VARCHAR)) AS rank
      FROM part WHERE p_type IS NOT NULL GROUP BY p_type) WHERE rank <= 20""")
def q_frequency_table(spark, sf):
    return P.frequency_table(table(spark, sf, "part"), "p_type", 20)


@register("frequency_summary", sql_with("""
SELECT 'o_orderpriority' AS column_name, count(DISTINCT o_orderpriority) AS unique_values,
  (SELECT o_orderpriority FROM dirty_orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority
   ORDER BY count(*) DESC, o_orderpriority LIMIT 1) AS most_common,
  CAST(count(*) - count(o_orderpriority) AS BIGINT) AS missing
FROM dirty_orders""", DIRTY_ORDERS_SQL))
def q_frequency_summary(spark, sf):
    return P.frequency_summary(dirty_orders(spark, sf), "o_orderpriority")


_LI = DIRTY_LINEITEM_NUMERIC
_PAIRS_CTE = "pairs AS (" + " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, '{_LI[i]}' AS variable_1, '{_LI[j]}' AS variable_2, "
    f"CASE WHEN stddev_pop(CASE WHEN {_LI[j]} IS NOT NULL THEN {_LI[i]} END) * "
    f"stddev_pop(CASE WHEN {_LI[i]} IS NOT NULL THEN {_LI[j]} END) > 0 "
    f"THEN corr({_LI[i]}, {_LI[j]}) END AS r FROM dirty_lineitem"
    for i in range(len(_LI)) for j in range(i + 1, len(_LI))) + ")"


@register("top_correlations", sql_with("""
SELECT variable_1, variable_2, round_even(r, 4) AS correlation,
  CASE WHEN abs(round_even(r, 4)) >= 0.7 THEN 'Strong' WHEN abs(round_even(r, 4)) >= 0.4 THEN 'Moderate' ELSE 'Weak' END AS strength
FROM pairs WHERE r IS NOT NULL ORDER BY abs(round_even(r, 4)) DESC, i, j LIMIT 10""", DIRTY_LINEITEM_SQL, _PAIRS_CTE))
def q_top_correlations(spark, sf):
    return P.top_correlations(dirty_lineitem(spark, sf), 10)


@register("top_correlations_strict", sql_with("""
SELECT variable_1, variable_2, round_even(r, 4) AS correlation,
  CASE WHEN abs(round_even(r, 4)) > 0.7 THEN 'Strong' WHEN abs(round_even(r, 4)) > 0.4 THEN 'Moderate' ELSE 'Weak' END AS strength
FROM pairs ORDER BY abs(round_even(r, 4)) DESC NULLS LAST, i, j LIMIT 10""", DIRTY_LINEITEM_SQL, _PAIRS_CTE))
def q_top_correlations_strict(spark, sf):
    return P.top_correlations(dirty_lineitem(spark, sf), 10, strict=True, keep_undefined=True)


@register("correlation_matrix", sql_with("""
SELECT variable_1 AS var_a, variable_2 AS var_b, round_even(r, 4) AS r FROM pairs
UNION ALL SELECT variable_2, variable_1, round_even(r, 4) FROM pairs
UNION ALL """ + " UNION ALL ".join(
    f"SELECT '{c}', '{c}', CASE WHEN stddev_pop({c}) > 0 AND count({c}) > 1 THEN 1.0 END FROM dirty_lineitem"
    for c in _LI), DIRTY_LINEITEM_SQL, _PAIRS_CTE))
def q_correlation_matrix(spark, sf):
    return P.correlation_matrix(dirty_lineitem(spark, sf))


@register("strongest_pair", sql_with("""
SELECT variable_1, variable_2, round_even(abs(r), 3) AS abs_correlation FROM pairs
WHERE abs(r) > 0 AND abs(r) < 1 ORDER BY abs(r) DESC, i, j LIMIT 1""", DIRTY_LINEITEM_SQL, _PAIRS_CTE))
def q_strongest_pair(spark, sf):
    return P.strongest_pair(dirty_lineitem(spark, sf))


_N = len(DIRTY_ORDERS_COLS)


def _outlier_pct_sql():
    parts = []
    for c in _DO_NUM_PRESENT:
        parts.append(f"""
SELECT round_even(count(*) FILTER (WHERE x < lo OR x > hi) / count(x) * 100, 2) AS pct
FROM (SELECT CAST({c} AS DOUBLE) AS x, lo, hi FROM dirty_orders,
      (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo,
              quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi
       FROM dirty_orders)) WHERE x IS NOT NULL""")
    return "op AS (" + " UNION ALL ".join(parts) + ")"


@register("profile_quality", sql_with(f"""
SELECT round_even(c, 2) AS completeness_score, round_even(u, 2) AS uniqueness_score,
  round_even((c + u - (SELECT avg(pct) FROM op)) / 2, 2) AS overall_quality_score,
  CASE WHEN c > 95 THEN 'Excellent' WHEN c > 80 THEN 'Good' WHEN c > 60 THEN 'Fair' ELSE 'Poor' END AS quality_grade
FROM (SELECT (1 - {sql_missing_cells(DIRTY_ORDERS_COLS)} / (count(*) * {_N})) * 100 AS c,
             (1 - {sql_duplicates('dirty_orders', DIRTY_ORDERS_COLS)} / count(*)) * 100 AS u
      FROM dirty_orders)""", DIRTY_ORDERS_SQL, _outlier_pct_sql()))
def q_profile_quality(spark, sf):
    return P.profile_quality(dirty_orders(spark, sf))


def _normality_sql():
    parts = []
    for c in _LI:
        parts.append(f"""
SELECT '{c}' AS column_name, n, round_even(jb, 4) AS jarque_bera, round_even(exp(-jb / 2), 6) AS p_value,
  exp(-jb / 2) >= 0.05 AS normal_at_5pct
FROM (SELECT n, CASE WHEN n >= 3 AND m2 > 0 THEN n / 6 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / pow(m2, 2) - 3, 2) / 4) END AS jb
      FROM (SELECT count(x) AS n, avg(pow(x - mu, 2)) AS m2, avg(pow(x - mu, 3)) AS m3, avg(pow(x - mu, 4)) AS m4
            FROM (SELECT CAST({c} AS DOUBLE) AS x, avg(CAST({c} AS DOUBLE)) OVER () AS mu FROM dirty_lineitem)))""")
    return sql_with(" UNION ALL ".join(parts), DIRTY_LINEITEM_SQL)


@register("normality", _normality_sql())
def q_normality(spark, sf):
    return P.normality(dirty_lineitem(spark, sf))


def mixed_orders(spark, sf):
    """dirty_orders plus a text column mixing numbers and words."""
    d = dirty_orders(spark, sf)
    return d.withColumn("o_mixed", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey").cast("string"))
                        .otherwise(F.col("o_orderstatus")))


_MIXED_SQL = ("mixed AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) "
              "ELSE o_orderstatus END AS o_mixed FROM dirty_orders)")
_MCOLS = DIRTY_ORDERS_COLS + ["o_mixed"]


def _weighted_sql():
    beyond = " OR ".join(
        f"coalesce(abs({c} - (SELECT avg({c}) FROM mixed)) > 3 * (SELECT stddev_samp({c}) FROM mixed), false)"
        for c in _DO_NUM_PRESENT)
    mixed_cnt = " + ".join(
        f"CAST(count(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NOT NULL) > 0 AND "
        f"count(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL) > 0 AS INTEGER)"
        for c in _DO_CAT + ["o_mixed"])
    n = len(_MCOLS)
    return sql_with(f"""
SELECT round_even(comp, 2) AS completeness, round_even(valid, 2) AS validity, round_even(cons, 2) AS consistency,
  round_even(dup, 2) AS uniqueness,
  round_even(0.35 * comp + 0.25 * valid + 0.2 * cons + 0.2 * dup, 2) AS weighted_score
FROM (SELECT (1 - {sql_missing_cells(_MCOLS)} / (count(*) * {n})) * 100 AS comp,
             count(*) FILTER (WHERE NOT ({beyond})) / count(*) * 100 AS valid,
             (1 - ({mixed_cnt}) / {n}) * 100 AS cons,
             (1 - {sql_duplicates('mixed', _MCOLS)} / count(*)) * 100 AS dup
      FROM mixed)""", DIRTY_ORDERS_SQL, _MIXED_SQL)


@register("weighted_quality", _weighted_sql())
def q_weighted_quality(spark, sf):
    return P.weighted_quality(mixed_orders(spark, sf))


# --- M1 (dataset part) and N6 ----------------------------------------------------

from tabsense.operators import reporting as RP  # noqa: E402

_DO_NUM = ["o_orderkey", "o_custkey", "o_totalprice", "o_amount", "o_blank"]


def _summary_sql():
    pairs = [(i, j) for i in range(len(_DO_NUM)) for j in range(i + 1, len(_DO_NUM))]
    pair_rows = " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, '{_DO_NUM[i]}' AS a, '{_DO_NUM[j]}' AS b, "
        f"CASE WHEN stddev_pop(CASE WHEN {_DO_NUM[j]} IS NOT NULL THEN {_DO_NUM[i]} END) * "
        f"stddev_pop(CASE WHEN {_DO_NUM[i]} IS NOT NULL THEN {_DO_NUM[j]} END) > 0 "
        f"THEN round_even(corr({_DO_NUM[i]}, {_DO_NUM[j]}), 3) END AS r FROM dirty_orders" for i, j in pairs)
    cats = " UNION ALL ".join(
        f"SELECT {k} AS pos, '{c}' AS col, {c} AS v, count(*) AS n FROM dirty_orders WHERE {c} IS NOT NULL GROUP BY {c}"
        for k, c in enumerate(_DO_CAT))
    return sql_with(f"""
SELECT CAST(line_no AS INTEGER) AS line_no, line FROM (
  SELECT 1 AS line_no, 'Dataset shape: ' || CAST(count(*) AS VARCHAR) || ' rows x 9 columns' AS line FROM dirty_orders
  UNION ALL SELECT 2, 'Numeric columns: o_orderkey, o_custkey, o_totalprice, o_amount, o_blank'
  UNION ALL SELECT 3, 'Categorical columns: o_orderstatus, o_orderpriority, o_channel'
  UNION ALL SELECT 4, 'Missing values: ' || CAST({sql_missing_cells(DIRTY_ORDERS_COLS)} AS VARCHAR) || ' total cells' FROM dirty_orders
  UNION ALL SELECT 100 + pos, col || ': {{' || string_agg('''' || v || ''': ' || CAST(n AS VARCHAR), ', ' ORDER BY rk) || '}}'
            FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) AS rk FROM ({cats})) WHERE rk <= 5
            GROUP BY pos, col
  UNION ALL SELECT 200 + row_number() OVER (ORDER BY abs(r) DESC, i, j), '  ' || a || ' <-> ' || b || ': ' || CAST(r AS VARCHAR)
            FROM (SELECT * FROM ({pair_rows}) WHERE r IS NOT NULL ORDER BY abs(r) DESC, i, j LIMIT 5))""",
        DIRTY_ORDERS_SQL)


@register("summary_lines", _summary_sql())
def q_summary_lines(spark, sf):
    return RP.summary_lines(dirty_orders(spark, sf))


@register("report_text_roundtrip", f"SELECT CAST(row_number() OVER (ORDER BY line_no) AS INTEGER) AS line_no, line FROM ({_summary_sql()})")
def q_report_text_roundtrip(spark, sf):
    """The summary written as one text file and read back, lines numbered as they stand in the file."""
    path = shared_scratch(spark, "report")
    write_report(RP.summary_lines(dirty_orders(spark, sf)), path)
    lines = F.split(F.rtrim(F.col("value"), F.lit("\n")), "\n")
    return spark.read.text(path, wholetext=True).select(F.posexplode(lines).alias("n", "line")).select((F.col("n") + 1).alias("line_no"), "line")


def _prof_sql(tab, cols, numeric, s):
    def stat(c):
        x = f"CAST({c} AS DOUBLE)"
        q = lambda e: f"round_even_sig({e}, 4)"
        if c not in numeric:
            return {k: "CAST(NULL AS DOUBLE)" for k in RP.COMPARED}
        return {"mean": q(f"avg({x})"), "median": q(f"quantile_cont({x}, 0.5)"), "std": q(f"stddev_samp({x})"), "min": q(f"min({x})"),
                "max": q(f"max({x})"), "q1": q(f"quantile_cont({x}, 0.25)"), "q3": q(f"quantile_cont({x}, 0.75)"),
                "skewness": _skew_sql(x, 4), "kurtosis": _kurt_sql(x, 4)}
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS count_{s}, round_even((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct_{s}, "
        + ", ".join(f"{e} AS {k}_{s}" for k, e in stat(c).items()) + f" FROM {tab}" for c in cols)


_ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@register("compare_profiles", sql_with(f"""
SELECT coalesce(pa.column_name, pb.column_name) AS column_name, count_a IS NOT NULL AS in_a, count_b IS NOT NULL AS in_b,
  count_a, count_b, missing_pct_a, missing_pct_b, round_even(missing_pct_b - missing_pct_a, 2) AS missing_pct_diff,
  {', '.join(f'{c}_{t}' for c in RP.COMPARED for t in 'ab')}, round_even(mean_b - mean_a, 4) AS mean_diff
FROM ({_prof_sql('orders', _ORDERS_COLS, ['o_orderkey', 'o_custkey', 'o_totalprice'], 'a')}) pa
FULL OUTER JOIN ({_prof_sql('dirty_orders', DIRTY_ORDERS_COLS, _DO_NUM_PRESENT, 'b')}) pb ON pa.column_name = pb.column_name""",
    DIRTY_ORDERS_SQL))
def q_compare_profiles(spark, sf):
    return RP.compare_profiles(table(spark, sf, "orders").select(*_ORDERS_COLS), dirty_orders(spark, sf))


def _describe_lines_sql():
    def cell(e, label):
        return f"'{label}=' || coalesce(printf('%.3f', round_even_sig({e}, 3)), 'NaN')"
    parts = ["SELECT 0 AS line_no, '=== Numeric Summary ===' AS line"]
    for i, c in enumerate(_DO_NUM):
        x = f"CAST({c} AS DOUBLE)"
        cells = [cell(f"CAST(count({c}) AS DOUBLE)", "count"), cell(f"avg({x})", "mean"), cell(f"stddev_samp({x})", "std"), cell(f"min({x})", "min"),
                 cell(f"quantile_cont({x}, 0.25)", "25%"), cell(f"quantile_cont({x}, 0.5)", "50%"), cell(f"quantile_cont({x}, 0.75)", "75%"), cell(f"max({x})", "max")]
        parts.append(f"SELECT {i + 1}, '{c}: ' || " + " || ', ' || ".join(cells) + " FROM dirty_orders")
    return sql_with("SELECT CAST(line_no AS INTEGER) AS line_no, line FROM (" + " UNION ALL ".join(parts) + ")", DIRTY_ORDERS_SQL)


@register("describe_lines", _describe_lines_sql())
def q_describe_lines(spark, sf):
    return RP.describe_lines(dirty_orders(spark, sf))
