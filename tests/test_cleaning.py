import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabsense.operators import cleaning as C
from tabsense.plans.cleaning_plan import CleanOptions, clean, preview_cleaning


def test_constant_and_all_null_columns(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None)], "x int, c string, z double")
    assert C.constant_columns(df) == ["c"]
    assert C.drop_constant_columns(df).columns == ["x", "z"]


def test_standardize_names_collisions(spark):
    df = spark.createDataFrame([(1, 2, 3)], "` Order ID` int, `order-id` int, `Order Id` int")
    assert C.standardize_names(df).columns == ["order_id", "order_id_2", "order_id_3"]


def test_index_columns(spark):
    df = spark.createDataFrame([(i, i * 2, 5 + i) for i in range(5)], "index bigint, `Unnamed: 0` bigint, v bigint")
    assert C.drop_index_columns(df).columns == ["v"]
    gap = spark.createDataFrame([(i if i < 3 else i + 1, i) for i in range(5)], "index bigint, v bigint")
    assert C.drop_index_columns(gap).columns == ["index", "v"]


def test_sparse_rows_threshold(spark):
    df = spark.createDataFrame([(1, None, None, None), (1, 2, None, None), (1, 2, 3, 4)], "a int, b int, c int, d int")
    # 50 % of 4 columns -> at most 2 missing cells
    assert C.drop_sparse_rows(df, 50).count() == 2
    assert C.drop_sparse_rows(df, 100).count() == 3


def test_fill_matches_pandas(spark):
    vals = [None, 1.0, None, 3.0, None, None, 7.0, None]
    pdf = pd.DataFrame({"k": range(len(vals)), "v": vals})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None)).select("k", F.col("v").cast("double"))
    ff = [r["v"] for r in C.impute_numeric(df, "ffill", order_by=["k"]).orderBy("k").collect()]
    bf = [r["v"] for r in C.impute_numeric(df, "bfill", order_by=["k"]).orderBy("k").collect()]
    exp_f = pdf["v"].ffill().tolist()
    exp_b = pdf["v"].bfill().tolist()
    assert [None if x is None else x for x in ff] == [None if np.isnan(x) else x for x in exp_f]
    assert [None if x is None else x for x in bf] == [None if np.isnan(x) else x for x in exp_b]


def test_two_level_fill_equals_plain_window(spark):
    from pyspark.sql import Window
    from tabsense.functions.ordered_fill import ordered_fill
    df = spark.range(5000).select(F.col("id").alias("k"),
                                  F.when((F.col("id") % 97 < 3) | (F.col("id") > 4990), F.col("id") * 1.5).alias("v"))
    two = ordered_fill(df, ["v"], ["k"], "forward", buckets=16).orderBy("k").collect()
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.select("k", F.last("v", True).over(w).alias("v")).orderBy("k").collect()
    assert [r["v"] for r in two] == [r["v"] for r in plain]


def test_mode_ties_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    out = [r["c"] for r in C.impute_categorical(df, "mode").collect()]
    assert sorted(out) == ["a", "a", "a", "b", "b"]


def test_cap_keeps_nulls_and_bounds(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 100]] + [(None,)], "x double")
    capped, n = C.cap_outliers_with_count(df, "iqr")
    vals = [r["x"] for r in capped.collect()]
    assert None in vals and n == 1
    q1, q3 = 2.0, 4.0
    assert max(v for v in vals if v is not None) <= q3 + 1.5 * (q3 - q1)


def test_remove_outliers_single_row_drops_all(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    assert C.remove_outliers(df).count() == 0


def test_clean_idempotent_dedup(spark, orders_fixture):
    once, log, summary = clean(orders_fixture, CleanOptions())
    twice, log2, _ = clean(once, CleanOptions())
    assert once.count() == twice.count() == 40
    assert log2.count() == 0
    assert summary.first()["rows_removed"] == 1


def test_preview_counts(spark, orders_fixture):
    r = preview_cleaning(orders_fixture, CleanOptions(fill_numeric="median", fill_categorical="mode")).first()
    assert r["duplicate_rows"] == 1 and r["numeric_to_fill"] == 3 and r["categorical_to_fill"] == 2


def test_two_level_fill_hot_first_key_spreads_and_equals_window(spark):
    """A third of the rows share one first-key value; with a tie-break key
    the rows are range-partitioned on the whole order and still fill like
    the plain window, without one bucket holding the hot value."""
    from pyspark.sql import Window
    from tabsense.functions.ordered_fill import order_buckets, ordered_fill
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).alias("k"), F.col("id").alias("t"),
        F.when(F.col("id") % 4 == 1, F.col("id") * 1.0).alias("v"))
    w = Window.orderBy("k", "t").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.select("k", "t", F.last("v", True).over(w).alias("v")).orderBy("k", "t").collect()
    two = ordered_fill(df, ["v"], ["k", "t"], "forward", buckets=16).orderBy("k", "t").collect()
    assert [tuple(r) for r in two] == [(r["k"], r["t"], r["v"]) for r in plain]
    sizes = [r["count"] for r in order_buckets(df, ["k", "t"], 16).groupBy("_b").count().collect()]
    assert max(sizes) < 1000


def test_constant_columns(spark):
    df = spark.createDataFrame(
        [(1, "a", -0.0, None, 2.5, "x"), (1, "a", 0.0, None, 3.5, "x"), (1, None, 0.0, None, 2.5, "y")],
        "i bigint, s string, z double, n double, d double, t string")
    assert C.constant_columns(df) == ["i", "s", "z"]


def test_constant_columns_compares_instants_at_any_width(spark):
    """Two instants an hour apart over a clock change read alike as local text; they are two values, in a wide table too."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        base = spark.createDataFrame([(1730610000,), (1730613600,)], "s bigint").select(F.timestamp_seconds("s").alias("ts"), "s")
        assert C.constant_columns(base) == []
        wide = base.select("ts", *[F.lit(i).alias(f"c{i}") for i in range(60)])
        assert C.constant_columns(wide) == [f"c{i}" for i in range(60)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_fill_hot_null_and_tied_keys_spread(spark):
    """A third of the rows share one key and a third have none; without a tie-break column the row hash splits them."""
    from tabsense.functions.ordered_fill import order_buckets
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"),
                                  F.col("id").alias("v"))
    sizes = [r["count"] for r in order_buckets(df, ["k"], 16).groupBy("_b").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 600


def test_backward_fill_is_one_pass(spark):
    """The window always ends at the current row, which Spark computes without going back over the frame."""
    df = spark.range(100).select(F.col("id").alias("k"), F.when(F.col("id") % 7 == 0, F.col("id") * 1.0).alias("v"))
    plan = C.impute_numeric(df, "bfill", order_by=["k"])._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing" not in plan and "unboundedpreceding" in plan.replace("$", "").lower()


def test_nan_is_missing_everywhere(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, nan), (2, 2.0), (3, None), (4, 6.0)], "a bigint, b double")
    assert [r["b"] for r in C.impute_numeric(df, "mean").orderBy("a").collect()] == [4.0, 2.0, 4.0, 6.0]
    assert [r["b"] for r in C.impute_numeric(df, "median").orderBy("a").collect()] == [4.0, 2.0, 4.0, 6.0]
    assert C.drop_sparse_rows(df, 49).count() == 2 == C.drop_missing(df).count()
    lo, hi = C.std_bounds(df, ["b"])["b"]
    assert lo < 2 and hi > 6


def test_quantile_bracket_of_few_values_and_low_estimate(spark):
    """A column of a few heavily repeated values, and a collect bound below the distinct values of a bracket."""
    from tabsense.functions.quantiles import exact_quantiles
    df = spark.range(20000).select((F.col("id") % 3).cast("double").alias("few"), ((F.col("id") * 7919) % 20011).cast("double").alias("many"))
    pdf = df.toPandas()
    got = exact_quantiles(df, ["few", "many"], [0.1, 0.5, 0.77], collect_bound=50)
    assert all(abs(v - pdf[c].quantile(p)) < 1e-9 for (c, p), v in got.items())


def test_high_cardinality_near_the_limit(spark):
    df = spark.range(3000).select(*[(F.col("id") % k).cast("string").alias(f"k{k}") for k in (5, 99, 100, 101, 110, 2000)])
    assert C.high_cardinality_columns(df, 100) == ["k101", "k110", "k2000"]
