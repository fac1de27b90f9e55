"""Every registered query against its DuckDB oracle at sf0.001."""

import math

import duckdb
import pytest

from conftest import SF_SMALL
from tabsense.plans import catalog
from tabsense.sources.tables import TABLES

QUERIES = catalog.queries()
ORACLE = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return c


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    return v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    cols = sdf.columns
    rows = sdf.collect()
    res = con.sql(ORACLE[name])
    dcols = res.columns
    drows = res.fetchall()
    assert sorted(cols) == sorted(dcols)
    order = sorted(cols)
    a = sorted((tuple(_norm(r[cols.index(c)]) for c in order) for r in rows), key=repr)
    b = sorted((tuple(_norm(r[dcols.index(c)]) for c in order) for r in drows), key=repr)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    """Queries that SQL cannot express: rows and ranges here, contents in the tests of their operators."""
    rows = QUERIES[name](spark, SF_SMALL).collect()
    assert rows
    for r in rows:
        for c in ("accuracy", "precision", "recall", "f1"):
            assert c not in r.asDict() or 0 <= r[c] <= 1
        assert "importance" not in r.asDict() or 0 <= r["importance"] <= 1
