"""Plan checks: no Python evaluation and no unpartitioned window over the
input rows in core operators."""

from tabsense.plans import catalog
from tabsense.sources.tables import dirty_orders, gappy_events
from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_udfs_in_core_queries(spark):
    for name in ["quality_scorecard", "drop_duplicates", "impute_median", "impute_ffill", "cap_iqr",
                 "profile_categorical", "histogram", "classification_table", "top_values"]:
        plan = _plan(catalog.queries()[name](spark, SF_SMALL))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_fill_window_is_partitioned(spark):
    from tabsense.operators.cleaning import impute_numeric
    df = impute_numeric(gappy_events(spark, "/root/testdata/sf0.01"), "ffill", order_by=["event_id"])
    plan = _plan(df)
    # the big window runs per bucket: partitioned by the bucket column
    assert "Window [last(value" in plan.replace("\n", " ") and "_b" in plan
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


def test_scan_prunes_columns(spark):
    from tabsense.operators.quality import missing_report
    df = missing_report(dirty_orders(spark, SF_SMALL).select("o_orderkey", "o_totalprice"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in plan
