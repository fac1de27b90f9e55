"""Queries of step 9: sources and sinks round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsense.plans.catalog import DIRTY_ORDERS_COLS, register
from tabsense.session import shared_scratch
from tabsense.sources.csv_scan import read_csv
from tabsense.sources.sinks import html_rows, write_table
from tabsense.sources.tables import DIRTY_ORDERS_SQL, dirty_orders, sql_with, table


def _sel_ts_text():
    return ", ".join(
        "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate" if c == "o_orderdate" else c
        for c in DIRTY_ORDERS_COLS)


@register("csv_roundtrip", sql_with(f"SELECT {_sel_ts_text()} FROM dirty_orders", DIRTY_ORDERS_SQL))
def q_csv_roundtrip(spark, sf):
    """Write the dirtied orders as CSV, read them back with type inference:
    keys bigint, prices double, dates text, the all-missing column double."""
    path = shared_scratch(spark, "csv")
    write_table(dirty_orders(spark, sf), path, "csv")
    return read_csv(spark, path)


@register("json_roundtrip", sql_with("SELECT * FROM dirty_orders", DIRTY_ORDERS_SQL))
def q_json_roundtrip(spark, sf):
    df = dirty_orders(spark, sf)
    path = shared_scratch(spark, "json")
    write_table(df, path, "json")
    back = spark.read.schema(df.schema).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").json(path)
    return back.select(*df.columns)


@register("parquet_roundtrip", sql_with("SELECT * FROM dirty_orders", DIRTY_ORDERS_SQL))
def q_parquet_roundtrip(spark, sf):
    df = dirty_orders(spark, sf)
    path = shared_scratch(spark, "parquet")
    write_table(df, path, "parquet")
    return spark.read.parquet(path)


@register("html_rows", """
SELECT '<tr><td>' || CAST(o_orderkey AS VARCHAR) || '</td><td>'
  || replace(replace(replace(o_orderstatus, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td><td>'
  || CAST(o_totalprice AS VARCHAR) || '</td><td>' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '</td><td>'
  || replace(replace(replace(o_orderpriority, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td></tr>' AS line
FROM orders""")
def q_html_rows(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                                          "o_orderpriority")
    return html_rows(o)


@register("csv_quoted_roundtrip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def q_csv_quoted_roundtrip(spark, sf):
    """Texts with quotes, commas and line feeds through the CSV sink and scan."""
    path = shared_scratch(spark, "csv-quoted")
    write_table(table(spark, sf, "documents"), path, "csv")
    return read_csv(spark, path)
