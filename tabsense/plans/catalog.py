"""Registered queries: one Spark callable and, where SQL can express it, the
equivalent DuckDB SQL.

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame computed
over the whole input tables (or data Spark derives from them).  Oracle SQL
runs on DuckDB views with the same table names.  Column names are aliased
identically on both sides; floating results are rounded half-even
(``bround`` / ``round_even``) so value hashes agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabsense.plans.sqltext import expand_rounding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = expand_rounding(sql)
        return fn
    return deco


# Column lists of the dirtied inputs (used to spell SQL group-by / null sums).
DIRTY_ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                     "o_orderpriority", "o_amount", "o_channel", "o_blank"]
DIRTY_ORDERS_NUMERIC = ["o_orderkey", "o_custkey", "o_totalprice", "o_amount", "o_blank"]
DIRTY_ORDERS_CATEGORICAL = ["o_orderstatus", "o_orderpriority", "o_channel"]
DIRTY_LINEITEM_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                       "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
DIRTY_LINEITEM_NUMERIC = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                          "l_discount", "l_tax"]


def sql_missing_cells(cols: list[str]) -> str:
    return "(" + " + ".join(f"(count(*) - count({c}))" for c in cols) + ")"


def sql_duplicates(table: str, cols: list[str]) -> str:
    return (f"(SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM "
            f"(SELECT count(*) AS n FROM {table} GROUP BY {', '.join(cols)}))")


def _load_all():
    # importing the modules registers their queries
    from tabsense.plans import q_quality  # noqa: F401
    from tabsense.plans import q_cleaning  # noqa: F401
    from tabsense.plans import q_profile  # noqa: F401
    from tabsense.plans import q_charts  # noqa: F401
    from tabsense.plans import q_models  # noqa: F401
    from tabsense.plans import q_io  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)
