"""Parquet tables of a scale-factor directory and the dirtied inputs.

The generated tables hold no NULLs and no duplicate rows, so quality and
cleaning operators are exercised on *dirtied* derivations.  Each derivation
exists twice with identical semantics: a DataFrame expression here and the
equivalent SQL text (``*_SQL``) used by the DuckDB oracle.  Both derive
from the whole base table, so their work grows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _null_unless(cond, col, dtype=None):
    v = F.lit(None) if dtype is None else F.lit(None).cast(dtype)
    return F.when(cond, v).otherwise(F.col(col))


def dirty_orders_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey", "o_custkey",
        _null_unless(k % 11 == 0, "o_orderstatus", "string").alias("o_orderstatus"),
        _null_unless(k % 7 == 0, "o_totalprice", "double").alias("o_totalprice"),
        "o_orderdate",
        _null_unless(k % 5 == 0, "o_orderpriority", "string").alias("o_orderpriority"),
        F.when(k % 13 == 0, F.col("o_totalprice") * 20)
         .otherwise(F.col("o_totalprice") / 100).alias("o_amount"),
        F.lit("web").alias("o_channel"),
        F.lit(None).cast("double").alias("o_blank"),
    )


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with missing cells, outliers, a constant and an all-null column,
    and every tenth order repeated (exact duplicate rows)."""
    base = dirty_orders_base(spark, sf_dir)
    return base.unionAll(base.where(F.col("o_orderkey") % 10 == 0))


DIRTY_ORDERS_SQL = """
dirty_orders_base AS (
  SELECT o_orderkey, o_custkey,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
    o_orderdate,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
    CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice * 20 ELSE o_totalprice / 100 END AS o_amount,
    'web' AS o_channel,
    CAST(NULL AS DOUBLE) AS o_blank
  FROM orders),
dirty_orders AS (
  SELECT * FROM dirty_orders_base
  UNION ALL
  SELECT * FROM dirty_orders_base WHERE o_orderkey % 10 = 0)"""


def dirty_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    k, ln = F.col("l_orderkey"), F.col("l_linenumber")
    return li.select(
        "l_orderkey", "l_linenumber",
        _null_unless(k % 6 == 0, "l_quantity", "double").alias("l_quantity"),
        _null_unless((k + ln) % 9 == 0, "l_extendedprice", "double").alias("l_extendedprice"),
        "l_discount", "l_tax",
        _null_unless((k + ln) % 8 == 0, "l_returnflag", "string").alias("l_returnflag"),
        "l_linestatus", "l_shipdate",
    )


DIRTY_LINEITEM_SQL = """
dirty_lineitem AS (
  SELECT l_orderkey, l_linenumber,
    CASE WHEN l_orderkey % 6 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
    CASE WHEN (l_orderkey + l_linenumber) % 9 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
    l_discount, l_tax,
    CASE WHEN (l_orderkey + l_linenumber) % 8 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
    l_linestatus, l_shipdate
  FROM lineitem)"""


def gappy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return ev.select(
        "event_id", "user_id",
        F.when(eid % 7 < 3, F.col("value")).alias("value"),
        F.when(eid % 5 < 2, F.col("event_type")).alias("event_type"),
    )


GAPPY_EVENTS_SQL = """
gappy_events AS (
  SELECT event_id, user_id,
    CASE WHEN event_id % 7 < 3 THEN value END AS value,
    CASE WHEN event_id % 5 < 2 THEN event_type END AS event_type
  FROM events)"""


def nan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with missing values both as NULL and as NaN."""
    ev = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return ev.select("event_id", F.when(eid % 6 == 0, F.lit(float("nan"))).when(eid % 4 != 0, F.col("value").cast("double")).alias("value"), "event_type")


NAN_EVENTS_SQL = """
nan_events AS (
  SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 4 <> 0 THEN CAST(value AS DOUBLE) END AS value, event_type
  FROM events)"""


def hot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gappy events whose first order key holds one value in a third of the rows and NULL in a third, and a text key."""
    ev = gappy_events(spark, sf_dir)
    eid = F.col("event_id")
    return ev.select(F.when(eid % 3 == 0, F.lit("hot")).when(eid % 3 == 1, F.concat(F.lit("k"), F.col("user_id").cast("string"))).alias("k"),
                     "event_id", "value")


HOT_EVENTS_SQL = """
hot_events AS (
  SELECT CASE WHEN event_id % 3 = 0 THEN 'hot' WHEN event_id % 3 = 1 THEN 'k' || CAST(user_id AS VARCHAR) END AS k, event_id, value
  FROM gappy_events)"""


def with_ctes(*ctes: str) -> str:
    """``WITH`` prefix joining several CTE definitions."""
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def sql_with(body: str, *ctes: str) -> str:
    return with_ctes(*ctes) + body
