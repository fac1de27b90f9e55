"""Queries of step 6 (chart inputs, previews) and documented chart data."""

from __future__ import annotations

from tabsense.operators import chartdata as CH
from tabsense.operators import profile as P
from tabsense.plans.catalog import register
from tabsense.sources.tables import (DIRTY_LINEITEM_SQL, DIRTY_ORDERS_SQL, dirty_lineitem,
                                     dirty_orders, sql_with, table)

_HIST_COLS = ["o_orderkey", "o_custkey", "o_totalprice", "o_amount"]


def _hist_sql():
    parts = []
    for c in _HIST_COLS:
        parts.append(f"""
SELECT '{c}' AS column_name, CAST(g.b AS INTEGER) AS bin, round_even(mn + g.b * w, 4) AS bin_start,
       round_even(mn + (g.b + 1) * w, 4) AS bin_end, coalesce(cnt.n, 0) AS count
FROM (SELECT min(CAST({c} AS DOUBLE)) AS mn, (max(CAST({c} AS DOUBLE)) - min(CAST({c} AS DOUBLE))) / 30 AS w
      FROM dirty_orders) r,
     range(30) g(b)
LEFT JOIN (SELECT CAST(least(floor((CAST({c} AS DOUBLE) - mn2) / w2), 29) AS INTEGER) AS bin, count(*) AS n
           FROM dirty_orders, (SELECT min(CAST({c} AS DOUBLE)) AS mn2,
                                      (max(CAST({c} AS DOUBLE)) - min(CAST({c} AS DOUBLE))) / 30 AS w2
                               FROM dirty_orders)
           WHERE {c} IS NOT NULL GROUP BY 1) cnt ON cnt.bin = g.b""")
    return sql_with(" UNION ALL ".join(parts), DIRTY_ORDERS_SQL)


@register("histogram", _hist_sql())
def q_histogram(spark, sf):
    return CH.histograms(dirty_orders(spark, sf))


_CATS = ["o_orderstatus", "o_orderpriority", "o_channel"]


@register("category_bars", sql_with("""
SELECT column_name, CAST(rank AS INTEGER) AS rank, value, count FROM (
  SELECT column_name, value, count, row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS rank
  FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS count FROM dirty_orders WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in _CATS) + ")) WHERE rank <= 10", DIRTY_ORDERS_SQL))
def q_category_bars(spark, sf):
    df = dirty_orders(spark, sf)
    from tabsense.functions.columns import categorical_columns
    return P.top_values(df, categorical_columns(df)[:CH.CATEGORY_COLUMNS], CH.CATEGORY_TOP)


_BOX_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _box_sql():
    parts = []
    for c in _BOX_COLS:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""
SELECT '{c}' AS column_name, count(x) AS n, round_even(q1, 4) AS q1, round_even(med, 4) AS median,
  round_even(q3, 4) AS q3, round_even(lo, 4) AS lower_fence, round_even(hi, 4) AS upper_fence,
  round_even(min(x) FILTER (WHERE x BETWEEN lo AND hi), 4) AS whisker_low,
  round_even(max(x) FILTER (WHERE x BETWEEN lo AND hi), 4) AS whisker_high,
  count(*) FILTER (WHERE x IS NOT NULL AND NOT (x BETWEEN lo AND hi)) AS outliers
FROM (SELECT {x} AS x FROM dirty_lineitem),
     (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS med, quantile_cont({x}, 0.75) AS q3,
             quantile_cont({x}, 0.25) - 1.5 * (quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)) AS lo,
             quantile_cont({x}, 0.75) + 1.5 * (quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)) AS hi
      FROM dirty_lineitem)
GROUP BY q1, med, q3, lo, hi""")
    return sql_with(" UNION ALL ".join(parts), DIRTY_LINEITEM_SQL)


@register("box_stats", _box_sql())
def q_box_stats(spark, sf):
    return CH.box_stats(dirty_lineitem(spark, sf), _BOX_COLS)


@register("scatter_sample", """
SELECT o_orderkey, o_totalprice, o_custkey FROM orders
WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL
ORDER BY CAST(('0x' || substr(md5(concat(CAST(o_orderkey AS VARCHAR), '42')), 1, 8)) AS BIGINT), o_orderkey
LIMIT 500""")
def q_scatter_sample(spark, sf):
    return CH.scatter_sample(table(spark, sf, "orders"), "o_totalprice", "o_custkey", 500, "o_orderkey")


@register("time_series", """
SELECT date_trunc('day', ts) AS period, count(*) AS n, round_even(sum(value), 4) AS total,
       round_even(avg(value), 4) AS mean
FROM events WHERE ts IS NOT NULL GROUP BY 1""")
def q_time_series(spark, sf):
    return CH.time_series(table(spark, sf, "events"), "ts", "value", "day")


@register("preview_rows", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def q_preview_rows(spark, sf):
    return CH.preview(table(spark, sf, "orders"), 10, ["o_orderkey"])
