from pyspark.sql import functions as F

from tabsense.operators import features as FE
from tabsense.operators import metrics as M
from tabsense.operators import models as ML


def test_classification_metrics_vs_formula(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a")]
    df = spark.createDataFrame(rows, "label string, prediction string")
    r = M.classification_metrics(df).first()
    assert abs(r["accuracy"] - 0.6) < 1e-12
    # per class: a p=1/2 r=1/2, b p=2/3 r=1, c p=0 r=0; weights 2,2,1
    assert abs(r["precision"] - (2 * 0.5 + 2 * (2 / 3)) / 5) < 1e-12
    assert abs(r["recall"] - (2 * 0.5 + 2 * 1.0) / 5) < 1e-12


def test_confusion_matrix_sums_to_n(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")]
    cm = M.confusion_matrix(spark.createDataFrame(rows, "label string, prediction string")).collect()
    assert len(cm) == 9 and sum(r["count"] for r in cm) == 4


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.0)], "label double, prediction double")
    r = M.regression_metrics(df).first()
    assert abs(r["mae"] - 0.5) < 1e-12 and abs(r["mse"] - (0.25 + 1) / 3) < 1e-12
    assert abs(r["r2"] - (1 - (1.25 / 3) / (2 / 3))) < 1e-12


def test_split_disjoint_and_complete(spark):
    df = FE.train_test_split(spark.range(5000).withColumnRenamed("id", "k"), "k", 0.2)
    c = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    assert c["train"] + c["test"] == 5000 and 800 < c["test"] < 1200


def test_recommend_no_model_above_minus_one(spark):
    m = spark.createDataFrame([("A", 0, -2.0, 1.0, 1.0, None, None), ("B", 1, -1.5, 1.0, 1.0, None, None)],
                              "model string, position int, r2 double, mae double, rmse double, cv_mean double, cv_std double")
    assert M.recommend(m, "regression", 500).count() == 0


def test_recommend_tie_first_wins(spark):
    m = spark.createDataFrame([("A", 0, 0.91, 0.9, 0.9, 0.9, 0.9, 0.01), ("B", 1, 0.91, 0.9, 0.9, 0.9, None, None),
                               ("C", 2, 0.5, 0.5, 0.5, 0.5, None, None)],
                              "model string, position int, accuracy double, precision double, recall double, f1 double, "
                              "cv_mean double, cv_std double")
    r = M.recommend(m, "classification", 500, folds=5).first()
    assert r["best_model"] == "A"
    assert r["alternatives"] == "B (within 0.0% of best)"
    assert "Excellent predictive power (91.0% accuracy)" in r["reasoning"]
    assert "Highly stable across 5-fold CV (std = 0.0100)" in r["reasoning"]
    assert "Small dataset detected" in r["reasoning"]


def test_scalers_fit_on_train(spark):
    df = spark.createDataFrame([(1.0, "train"), (3.0, "train"), (10.0, "test")], "x double, split string")
    s = {r["split"] + str(i): r["x"] for i, r in enumerate(FE.scale(df, ["x"], "standard").collect())}
    assert abs(s["train0"] + 1.0) < 1e-12 and abs(s["test2"] - 8.0) < 1e-12
    m = [r["x"] for r in FE.scale(df, ["x"], "minmax").collect()]
    assert m[:2] == [0.0, 1.0] and abs(m[2] - 4.5) < 1e-12


def test_smote_exact_quotas_and_bounds(spark):
    rows = [(float(i), float(i % 7), "big") for i in range(300)] + \
           [(1000.0 + i, 3.0 * i, "mid") for i in range(70)] + [(5.0, 5.0, "one")]
    df = spark.createDataFrame(rows, "x double, y double, cls string")
    out = FE.smote(df, "cls", ["x", "y"], k=3, buckets=4)
    counts = {r["cls"]: r["count"] for r in out.groupBy("cls").count().collect()}
    assert counts == {"big": 300, "mid": 300, "one": 300}
    mid = out.where("cls = 'mid' AND synthetic").agg(F.min("x"), F.max("x")).first()
    assert mid[0] >= 1000.0 and mid[1] <= 1069.0
    one = out.where("cls = 'one'").select("x", "y").distinct().collect()
    assert [(r["x"], r["y"]) for r in one] == [(5.0, 5.0)]


def test_smote_chunked_copies_equal_unchunked(spark, monkeypatch):
    """A seed row's copies split over chunks give the same synthetic rows."""
    rows = [(float(i), float(i % 7), "big") for i in range(300)] + [(5.0, 5.0, "one"), (7.0, 1.0, "two")]
    df = spark.createDataFrame(rows, "x double, y double, cls string")
    whole = sorted(FE.smote(df, "cls", ["x", "y"], k=3, buckets=4).collect())
    monkeypatch.setattr(FE, "SMOTE_CHUNK", 7)
    chunked = sorted(FE.smote(df, "cls", ["x", "y"], k=3, buckets=4).collect())
    assert chunked == whole and len(whole) == 900


def test_tree_sees_sixty_categories_scaled_or_not(spark):
    """A text feature of 60 values that determines the target exactly."""
    from tabsense.operators import models as ML
    df = spark.range(1200).select(F.concat(F.lit("v"), F.lpad((F.col("id") % 60).cast("string"), 2, "0")).alias("x"),
                                  F.floor((F.col("id") % 60) / 7 % 2).cast("double").alias("y"), F.col("id").alias("k"))
    for scaling in ("none", "standard", "minmax"):
        run = ML.train_models(df, "y", ["x"], "classification", ["Decision Tree"], key="k", scaling=scaling, options=ML.ModelOptions(max_depth=10))
        assert run.metrics.first()["accuracy"] > 0.95, scaling


def test_stratified_split_is_exact(spark):
    df = spark.range(1003).select("id", F.when(F.col("id") < 7, "rare").when(F.col("id") % 3 == 0, None).otherwise("big").alias("c"))
    out = FE.stratified_split(df, "id", "c", 0.2)
    n = {(r["c"], r["split"]): r["count"] for r in out.groupBy("c", "split").count().collect()}
    assert sum(v for (_, s), v in n.items() if s == "test") == 201 and sum(n.values()) == 1003
    for c in ("rare", "big", None):
        assert abs(n[c, "test"] - 0.2 * (n[c, "test"] + n[c, "train"])) < 1


def test_confusion_matrix_counts_missing_and_rejects_continuous(spark):
    import pytest
    cm = M.confusion_matrix(spark.createDataFrame([("a", None), (None, "b"), ("a", "a")], "label string, prediction string")).collect()
    assert sum(r["count"] for r in cm) == 3
    wide = spark.range(5000).select(F.col("id").alias("label"), F.col("id").alias("prediction"))
    with pytest.raises(Exception, match="not categorical"):
        M.confusion_matrix(wide).collect()


def test_training_maps_text_targets_back_and_balances(spark):
    from tabsense.operators import models as ML
    df = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 50).cast("double").alias("x"),
                                 F.when(F.col("id") % 50 < 5, "low").otherwise("high").alias("y"))
    run = ML.train_models(df, "y", ["x"], "classification", ["Decision Tree"], key="k", balance=True)
    p = run.predictions.collect()
    assert {r["prediction_text"] for r in p} == {"low", "high"} and len(p) == 80
    assert all((r["label_text"] == "low") == (r["label"] == 1.0) for r in p)
    assert run.metrics.first()["accuracy"] == 1.0


def test_next_steps(spark):
    m = spark.createDataFrame([("A", 0, 0.75, 0.7, 0.7, 0.7, None, None, 5000)],
                              "model string, position int, accuracy double, precision double, recall double, f1 double, cv_mean double, cv_std double, n bigint")
    assert M.recommend(m, "classification").first()["next_steps"] == " | ".join(M.NEXT_CLASSIFICATION)


def test_registered_runs_have_the_operators_own_sizes(spark, monkeypatch):
    """Depth, trees and rounds of the registered model queries are the defaults of train_models."""
    import inspect

    import pytest
    from conftest import SF_SMALL
    from tabsense.operators import models as ML
    from tabsense.plans import catalog
    given, sign = [], inspect.signature(ML.train_models)

    class Given(Exception):
        pass

    def stand_in(*args, **kw):
        bound = sign.bind(*args, **kw)
        bound.apply_defaults()
        given.append(bound.arguments["options"])
        raise Given

    monkeypatch.setattr(ML, "train_models", stand_in)
    for name in ("train_classifier", "train_classifier_ensembles", "train_classifier_balanced", "train_regressor",
                 "train_regressor_ensembles", "feature_importance"):
        with pytest.raises(Given):
            catalog.queries()[name](spark, SF_SMALL)
    assert given == [ML.ModelOptions(max_depth=10, trees=100, rounds=100)] * 6


def test_regression_comparison_keeps_every_model(spark):
    from conftest import SF_SMALL
    from tabsense.plans import catalog
    rows = catalog.queries()["comparison_table_regression"](spark, SF_SMALL).collect()
    assert {r["model"] for r in rows} == {"Quantity x1500", "Rounded price", "Quantity x1000"} and len(rows) == 3


def test_stratified_split_leaves_rows_where_they_are(spark):
    """Rows are not gathered by class, whatever the sizes that the planner guesses; a rank column of one's own gives the same split."""
    from tabsense.operators.chartdata import md5_rank
    df = spark.range(0, 400, 1, 8).select("id", (F.col("id") % 20 == 0).cast("string").alias("label"))
    want = {tuple(r) for r in FE.stratified_split(df, "id", "label").collect()}
    ranked = FE.stratified_split(df.withColumn("rank", md5_rank("id", FE.DEFAULT_SEED)), "id", "label", rank="rank")
    assert ranked.columns == ["id", "label", "split"] and {tuple(r) for r in ranked.collect()} == want
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for c, v in zip(old, ("-1", "false")):
        spark.conf.set(c, v)
    try:
        plan = FE.stratified_split(df, "id", "label")._jdf.queryExecution().executedPlan().toString()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 4


def test_rows_of_spark_fits_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(ML, "ROWS_PER_TASK", 50)
    train = spark.range(0, 1000, 1, 1).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 3).cast("int").alias("fold"))
    made = ML._SparkFits(train, ["x"], "classification", 3, 1000, 1, ML.ModelOptions())
    sizes = [len(p) for p in made.train.rdd.glom().collect()]
    assert len(sizes) == 20 and max(sizes) <= 100


def test_folds_are_scored_one_by_one_on_many_rows(spark, monkeypatch):
    """One score a fold, that of a fit on the other folds; beyond ROWS_AT_ONCE no two fits hold their rows at the same time, and
    no fold is cached as a table."""
    import threading

    from tabsense.operators import models as ML
    monkeypatch.setattr(ML, "ROWS_AT_ONCE", 100)
    train = spark.range(0, 600, 1, 2).select((F.col("id") % 37).cast("double").alias("x"), (F.col("id") % 37 % 4 > 1).cast("double").alias("label"), (F.col("id") % 3).cast("int").alias("fold"))
    made = ML._SparkFits(train, ["x"], "classification", 3, 600, 1, ML.ModelOptions(max_depth=2))
    busy, score, cached = threading.Lock(), made._score, []
    monkeypatch.setattr(type(made.train), "cache", lambda df: cached.append(df) or df)

    def alone(estimator, fold):
        assert busy.acquire(blocking=False)
        try:
            return score(estimator, fold)
        finally:
            busy.release()

    made._score = alone
    _, scores = made.fit("Decision Tree")
    want = []
    for f in range(3):
        tree = ML.make_estimator("Decision Tree", "classification", 600, 1, ML.ModelOptions(max_depth=2)).fit(made.train.where(F.col("fold") != f))
        p = tree.transform(made.train.where(F.col("fold") == f)).select("label", "prediction").collect()
        want.append(sum(r[0] == r[1] for r in p) / len(p))
    assert scores == want and not cached and len(set(scores)) > 1
