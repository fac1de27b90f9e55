from tabsense.operators import quality as Q


def test_scorecard_by_hand(orders_fixture):
    r = Q.quality_scorecard(orders_fixture).first()
    # 41*13 = 533 cells, 5 missing -> 99.0619; 1 duplicate of 41 -> 2.439
    assert r["total_rows"] == 41 and r["total_cols"] == 13
    assert r["missing_cells"] == 5 and r["duplicate_rows"] == 1
    assert r["completeness"] == 99.1
    assert r["duplicate_rate"] == 2.4
    assert r["score"] == 96.6


def test_duplicate_count_equals_grouping(spark, orders_fixture):
    n = orders_fixture.count() - orders_fixture.distinct().count()
    assert Q.duplicate_count(orders_fixture).first()[0] == n == 1


def test_duplicates_treat_nulls_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert Q.duplicate_count(df).first()[0] == 1


def test_empty_table_guards(spark):
    df = spark.createDataFrame([], "a int, b string")
    r = Q.quality_scorecard(df).first()
    assert r["total_rows"] == 0 and r["completeness"] == 0.0 and r["duplicate_rate"] == 0.0


def test_quality_labels(spark, orders_fixture):
    r = Q.quality_labels(Q.quality_scorecard(orders_fixture)).first()
    assert r["quality_level"] == "EXCELLENT" and r["color_band"] == "green"
    assert r["context_notes"] == ""


def test_missing_report(orders_fixture):
    rows = {r["column_name"]: (r["missing_count"], r["missing_pct"]) for r in Q.missing_report(orders_fixture).collect()}
    assert rows == {"country": (2, 4.88), "rating": (3, 7.32)}


def test_null_counts_of_a_wide_table(spark):
    from pyspark.sql import functions as F
    from tabsense.operators import quality as Q
    df = spark.range(300).select(*[F.when((F.col("id") + i) % (i + 2) == 0, None).otherwise(F.col("id"))
                                   .alias(f"c{i}") for i in range(120)])
    got = {r["column_name"]: (r["missing_count"], r["total_rows"]) for r in Q.null_counts_long(df).collect()}
    assert got == {f"c{i}": (sum((k + i) % (i + 2) == 0 for k in range(300)), 300) for i in range(120)}
    assert Q.quality_scorecard(df).first()["missing_cells"] == sum(n for n, _ in got.values())


def test_duplicates_tell_null_places_apart_and_survive_a_hot_row(spark):
    """A NULL is part of the row's identity; one row held by a third of the table is summed on the map side."""
    from tabsense.operators import quality as Q
    df = spark.createDataFrame([(1, None), (None, 1), (1, None), (None, None), (None, None), (1, 1)], "a bigint, b bigint")
    assert Q.duplicate_count(df).first()[0] == 2
    from pyspark.sql import functions as F
    hot = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("a"), F.lit("x").alias("b"))
    counted = Q.table_counts(hot)
    assert tuple(counted.first()) == (3000, 0, 999)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Scan") + plan.count("Range") <= 2


def test_fixed_digits_equal_c(spark):
    """Ties, near ties on both sides, signs, small and large numbers, as Python formats the binary value."""
    import random
    from pyspark.sql import functions as F
    from tabsense.functions.stats import fixed
    rng = random.Random(1)
    values = [0.33375, 0.5, 1.5, 2.5, -2.5, 0.125, 0.375, -0.125, 1e-9, -1e-9, 0.0, 99.995, 1.005, 2.675, 9.9999, 9.99995, 1e8 + 0.5, 123456789.00005, 3e20, 1e11 + 0.3]
    values += [rng.randint(0, 10 ** 6) / 10 ** rng.randint(1, 7) for _ in range(3000)] + [rng.randint(0, 2 ** 20) / 2 ** rng.randint(1, 12) for _ in range(2000)]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-6, 9) for _ in range(2000)] + [float(f"{rng.randint(0, 9999)}.{rng.randint(0, 9999):04d}5") for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    for d in (0, 1, 2, 3, 4):
        got = [r[0] for r in df.select(fixed(F.col("x"), d)).collect()]
        assert got == [f"{v:.{d}f}" for v in values] + [None]
