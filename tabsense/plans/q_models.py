"""Queries of steps 7-8: features, metrics, model ranking and recommendation.

Metric queries evaluate deterministic stand-in predictors (plain SQL
expressions over the whole ``lineitem`` table) so that DuckDB can check the
evaluation logic; the trained ``pyspark.ml`` models are registered as
rows-only queries.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsense.functions.stats import round_sig
from tabsense.operators import features as FE
from tabsense.operators import metrics as M
from tabsense.operators.chartdata import md5_rank
from tabsense.plans.catalog import register
from tabsense.sources.tables import DIRTY_LINEITEM_SQL, dirty_lineitem, sql_with, table

# Stand-in predictors: (model name, prediction expression valid in Spark SQL and DuckDB)
CLS_MODELS = [
    ("Quantity rule", "CASE WHEN l_quantity < 20 THEN 'A' WHEN l_linestatus = 'F' THEN 'R' ELSE 'N' END"),
    ("Status rule", "CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'R' END"),
    ("Majority", "'N'"),
    ("Discount rule", "CASE WHEN l_discount >= 0.05 THEN 'A' ELSE 'N' END"),
]
REG_MODELS = [
    ("Quantity x1500", "l_quantity * 1500"),
    ("Rounded price", "round(l_extendedprice, -3)"),
    ("Quantity x1000", "l_quantity * 1000"),
]
FOLDS = 3
FOLD_SQL = "CAST(('0x' || substr(md5(concat(CAST(l_orderkey AS VARCHAR), '42')), 1, 8)) AS BIGINT) % 3"


def _long_predictions(spark, sf, models, label):
    li = table(spark, sf, "lineitem")
    arr = F.array(*[F.struct(F.lit(name).alias("model"), F.lit(i).alias("position"),
                             F.expr(expr).alias("prediction")) for i, (name, expr) in enumerate(models)])
    # row-level columns are computed below the explode (once per row, not
    # once per model)
    return li.select("*", (md5_rank("l_orderkey") % FOLDS).alias("fold"),
                     F.year("l_shipdate").alias("ship_year")) \
        .select(F.explode(arr).alias("m"), F.col(label).alias("label"), "fold", "ship_year") \
        .select("m.model", "m.position", "m.prediction", "label", "fold", "ship_year")


def _sql_long(models, label):
    return "preds AS (" + " UNION ALL ".join(
        f"SELECT '{name}' AS model, {i} AS position, {expr} AS prediction, {label} AS label, "
        f"{FOLD_SQL} AS fold, year(l_shipdate) AS ship_year FROM lineitem"
        for i, (name, expr) in enumerate(models)) + ")"


def classification_table(spark, sf, by_year=False):
    """Metrics table of the stand-in classifiers with 3-fold CV accuracy."""
    p = _long_predictions(spark, sf, CLS_MODELS, "l_returnflag")
    keys = ["model", "position"] + (["ship_year"] if by_year else [])
    # one pass over the rows: the confusion cells per fold feed both the
    # overall and the per-fold metrics (the shuffle is reused by both)
    cells = p.groupBy(*keys, "fold", "label", "prediction").agg(F.count(F.lit(1)).alias("_w"))
    met = M.classification_metrics(cells, by=keys, weight="_w")
    folds = M.classification_metrics(cells, by=keys + ["fold"], weight="_w")
    cv = folds.groupBy(*keys).agg(F.avg("accuracy").alias("cv_mean"), F.stddev_pop("accuracy").alias("cv_std"))
    return met.join(cv, keys)


def regression_table(spark, sf):
    p = _long_predictions(spark, sf, REG_MODELS, "l_extendedprice")
    keys = ["model", "position"]
    met = M.regression_metrics(p, by=keys)
    folds = M.regression_metrics(p, by=keys + ["fold"])
    cv = folds.groupBy(*keys).agg(F.avg("r2").alias("cv_mean"), F.stddev_pop("r2").alias("cv_std"))
    return met.join(cv, keys)


def _cls_metrics_sql(keys: str) -> list[str]:
    return [
        f"cm AS (SELECT {keys}, label, prediction, count(*) AS n FROM preds GROUP BY ALL)",
        f"truth AS (SELECT {keys}, label AS c, sum(n) AS support, sum(CASE WHEN label = prediction THEN n END) AS tp "
        f"FROM cm GROUP BY ALL)",
        f"predc AS (SELECT {keys}, prediction AS c, sum(n) AS predicted FROM cm GROUP BY ALL)",
        "per AS (SELECT " + ", ".join(f"coalesce(t.{k}, p.{k}) AS {k}" for k in keys.split(", "))
        + ", coalesce(t.c, p.c) AS c, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, "
        "coalesce(predicted, 0) AS predicted FROM truth t FULL OUTER JOIN predc p ON "
        + " AND ".join(f"t.{k} = p.{k}" for k in keys.split(", ")) + " AND t.c = p.c)",
        "per2 AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS pr, "
        "CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rc FROM per)",
        "per3 AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f FROM per2)",
        f"met AS (SELECT {keys}, sum(tp) / sum(support) AS accuracy, sum(support * pr) / sum(support) AS precision, "
        f"sum(support * rc) / sum(support) AS recall, sum(support * f) / sum(support) AS f1, "
        f"CAST(sum(support) AS BIGINT) AS n FROM per3 GROUP BY ALL)",
    ]


def _rename(ctes: list[str], suffix: str) -> list[str]:
    """Copy of a CTE chain with every CTE name suffixed (for a second use)."""
    names = ["cm", "truth", "predc", "per3", "per2", "per", "met", "preds"]
    out = []
    import re
    for c in ctes:
        for n in names:
            c = re.sub(rf"\b{n}\b", n + suffix, c)
        out.append(c)
    return out


def _cls_table_sql(by_year=False):
    keys = "model, position" + (", ship_year" if by_year else "")
    main = _cls_metrics_sql(keys)
    fold = _rename(_cls_metrics_sql(keys + ", fold"), "_f")
    cv = (f"cv AS (SELECT {keys}, avg(accuracy) AS cv_mean, stddev_pop(accuracy) AS cv_std FROM met_f GROUP BY ALL)")
    tab = (f"mt AS (SELECT met.*, cv.cv_mean, cv.cv_std FROM met JOIN cv USING ({keys}))")
    return [_sql_long(CLS_MODELS, "l_returnflag"), *main,
            _sql_long(CLS_MODELS, "l_returnflag").replace("preds AS", "preds_f AS", 1), *fold, cv, tab]


def _reg_table_sql():
    parts = []
    for suffix, keys in (("", "model, position"), ("_f", "model, position, fold")):
        parts.append(
            f"rm{suffix} AS (SELECT {keys}, CASE WHEN var_pop(CAST(label AS DOUBLE)) > 0 THEN "
            f"1 - avg((label - prediction) * (label - prediction)) / var_pop(CAST(label AS DOUBLE)) "
            f"WHEN avg((label - prediction) * (label - prediction)) = 0 THEN 1.0 ELSE 0.0 END AS r2, "
            f"avg(abs(label - prediction)) AS mae, avg((label - prediction) * (label - prediction)) AS mse, "
            f"sqrt(avg((label - prediction) * (label - prediction))) AS rmse, count(*) AS n "
            f"FROM rpreds WHERE label IS NOT NULL AND prediction IS NOT NULL GROUP BY ALL)")
    return [_sql_long(REG_MODELS, "l_extendedprice").replace("preds AS", "rpreds AS", 1), *parts,
            "rcv AS (SELECT model, position, avg(r2) AS cv_mean, stddev_pop(r2) AS cv_std FROM rm_f GROUP BY ALL)",
            "rt AS (SELECT rm.*, rcv.cv_mean, rcv.cv_std FROM rm JOIN rcv USING (model, position))"]


def _r4(cols):
    return ", ".join(f"round_even({c}, 4) AS {c}" for c in cols)


# --- J1 ----------------------------------------------------------------------

_RULE_A = CLS_MODELS[0][1]


@register("classification_metrics", sql_with(
    "SELECT " + _r4(["accuracy", "precision", "recall", "f1"]) + ", n FROM met",
    f"preds AS (SELECT 'Quantity rule' AS model, 0 AS position, {_RULE_A} AS prediction, l_returnflag AS label FROM lineitem)",
    *_cls_metrics_sql("model, position")))
def q_classification_metrics(spark, sf):
    li = table(spark, sf, "lineitem")
    pred = li.select(F.col("l_returnflag").alias("label"), F.expr(_RULE_A).alias("prediction"))
    m = M.classification_metrics(pred)
    return m.select(*[F.bround(c, 4).alias(c) for c in ("accuracy", "precision", "recall", "f1")], "n")


@register("classification_table", sql_with(
    "SELECT model, position, " + _r4(["accuracy", "precision", "recall", "f1", "cv_mean", "cv_std"]) + ", n FROM mt",
    *_cls_table_sql()))
def q_classification_table(spark, sf):
    t = classification_table(spark, sf)
    return t.select("model", "position", *[F.bround(c, 4).alias(c) for c in
                                           ("accuracy", "precision", "recall", "f1", "cv_mean", "cv_std")], "n")


# --- J2 ----------------------------------------------------------------------

def _rsig(cols):
    return ", ".join(f"round_even_sig({c}, 4) AS {c}" for c in cols)


@register("regression_metrics", sql_with(
    "SELECT " + _rsig(["r2", "mae", "mse", "rmse"]) + ", n FROM rm",
    "rpreds AS (SELECT 'Quantity x1500' AS model, 0 AS position, l_quantity * 1500 AS prediction, "
    "l_extendedprice AS label FROM lineitem)",
    _reg_table_sql()[1]))
def q_regression_metrics(spark, sf):
    li = table(spark, sf, "lineitem")
    pred = li.select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction"))
    m = M.regression_metrics(pred)
    return m.select(*[round_sig(c, 4).alias(c) for c in ("r2", "mae", "mse", "rmse")], "n")


@register("regression_table", sql_with(
    "SELECT model, position, " + _rsig(["r2", "mae", "mse", "rmse", "cv_mean", "cv_std"]) + ", n FROM rt",
    *_reg_table_sql()))
def q_regression_table(spark, sf):
    t = regression_table(spark, sf)
    return t.select("model", "position", *[round_sig(c, 4).alias(c) for c in
                                           ("r2", "mae", "mse", "rmse", "cv_mean", "cv_std")], "n")


# --- J4 ----------------------------------------------------------------------

@register("confusion_matrix", f"""
WITH cm AS (SELECT CAST(l_returnflag AS VARCHAR) AS actual, CAST({_RULE_A} AS VARCHAR) AS predicted, count(*) AS n
            FROM lineitem GROUP BY ALL),
     cls AS (SELECT actual AS c FROM cm UNION SELECT predicted FROM cm)
SELECT a.c AS actual, b.c AS predicted, CAST(coalesce(cm.n, 0) AS BIGINT) AS count
FROM cls a, cls b LEFT JOIN cm ON cm.actual = a.c AND cm.predicted = b.c""")
def q_confusion_matrix(spark, sf):
    li = table(spark, sf, "lineitem")
    return M.confusion_matrix(li.select(F.col("l_returnflag").alias("label"), F.expr(_RULE_A).alias("prediction")))


# --- J5 / J8 / L4 --------------------------------------------------------------

@register("best_model", sql_with("""
SELECT ship_year, model, position, round_even(accuracy, 4) AS accuracy FROM (
  SELECT *, row_number() OVER (PARTITION BY ship_year ORDER BY accuracy DESC NULLS LAST, position) AS rk FROM mt)
WHERE rk = 1""", *_cls_table_sql(by_year=True)))
def q_best_model(spark, sf):
    t = classification_table(spark, sf, by_year=True)
    b = M.best_model(t, "accuracy", by=["ship_year"])
    return b.select("ship_year", "model", "position", F.bround("accuracy", 4).alias("accuracy"))


@register("model_comparison", sql_with("""
SELECT model, position, metric, value FROM (
  SELECT model, position, 'Accuracy' AS metric, round_even(accuracy, 4) AS value FROM mt
  UNION ALL SELECT model, position, 'Precision', round_even(precision, 4) FROM mt
  UNION ALL SELECT model, position, 'Recall', round_even(recall, 4) FROM mt
  UNION ALL SELECT model, position, 'F1-Score', round_even(f1, 4) FROM mt)""", *_cls_table_sql()))
def q_model_comparison(spark, sf):
    return M.model_comparison(classification_table(spark, sf), "classification", long=True)


@register("comparison_table", sql_with("""
SELECT model, position, round_even(accuracy, 4) AS accuracy, round_even(precision, 4) AS precision,
  round_even(recall, 4) AS recall, round_even(f1, 4) AS f1, round_even(cv_mean, 4) AS cv_mean, round_even(cv_std, 4) AS cv_std,
  CASE WHEN cv_mean IS NOT NULL AND cv_mean <> 0 THEN round_even(cv_mean, 4) END AS cv_score FROM mt""",
    *_cls_table_sql()))
def q_comparison_table(spark, sf):
    return M.model_comparison(classification_table(spark, sf), "classification", long=False)


# --- J9 ----------------------------------------------------------------------

def _pct1(x):
    return f"printf('%.1f', round_even({x}, 1))"


def _fmt(x, d):
    return f"printf('%.{d}f', round_even({x}, {d}))"


def _next_sql(score, low, weak):
    return (f"CASE WHEN {score} < {low} THEN '{' | '.join(weak)}' WHEN {score} >= 0.85 THEN '{' | '.join(M.NEXT_GOOD)}' ELSE '' END")


@register("comparison_table_regression", sql_with(
    "SELECT model, position, " + _rsig(["r2", "mae", "mse", "rmse", "cv_mean", "cv_std"]) + ", "
    "CASE WHEN cv_mean IS NOT NULL AND cv_mean <> 0 THEN round_even_sig(cv_mean, 4) END AS cv_score FROM rt", *_reg_table_sql()))
def q_comparison_table_regression(spark, sf):
    """Every model of the table, compared by significant digits."""
    t = M.model_comparison(regression_table(spark, sf), "regression", long=False)
    return t.select("model", "position", *[round_sig(c, 4).alias(c) for c in
                                           ("r2", "mae", "mse", "rmse", "cv_mean", "cv_std", "cv_score")])


def _recommend_cls_sql():
    size = ("CASE WHEN (SELECT count(*) FROM lineitem) < 1000 THEN 'Small dataset detected - consider simpler models or data augmentation' "
            "WHEN (SELECT count(*) FROM lineitem) > 100000 THEN 'Large dataset - gradient boosting or deep learning could improve results' END")
    pct = _pct1("b.accuracy * 100")
    perf = (f"CASE WHEN b.accuracy >= 0.9 THEN 'Excellent predictive power (' || {pct} || '% accuracy)' "
            f"WHEN b.accuracy >= 0.8 THEN 'Strong predictive power (' || {pct} || '% accuracy)' "
            f"WHEN b.accuracy >= 0.7 THEN 'Moderate predictive power (' || {pct} || '% accuracy)' "
            f"ELSE 'Room for improvement (' || {pct} || '% accuracy)' END")
    bal = (f"CASE WHEN abs(b.precision - b.recall) < 0.05 THEN 'Well-balanced between precision and recall' "
           f"ELSE 'Trade-off detected: Precision=' || {_fmt('b.precision', 3)} || ', Recall=' || {_fmt('b.recall', 3)} END")
    f1 = ("CASE WHEN b.f1 >= 0.85 THEN 'Excellent F1-score - great overall performance' "
          "WHEN b.f1 >= 0.7 THEN 'Good F1-score - reliable predictions' END")
    truthy = "(b.cv_mean IS NOT NULL AND b.cv_mean <> 0 AND b.cv_std IS NOT NULL AND b.cv_std <> 0)"
    cv = (f"CASE WHEN {truthy} AND b.cv_std < 0.05 THEN 'Highly stable across 3-fold CV (std = ' || {_fmt('b.cv_std', 4)} || ')' "
          f"WHEN {truthy} AND b.cv_std < 0.1 THEN 'Moderately stable across CV folds (std = ' || {_fmt('b.cv_std', 4)} || ')' "
          f"WHEN {truthy} THEN 'High variance detected - consider more data or regularization' END")
    return sql_with(f"""
SELECT b.model AS best_model, round_even(b.accuracy, 4) AS best_score, 'Accuracy' AS primary_metric,
  concat_ws(' | ', {perf}, {bal}, {f1}, {cv}, {size}) AS reasoning,
  coalesce((SELECT string_agg(model || ' (within ' || {_pct1('(b.accuracy - accuracy) * 100')} || '% of best)', '; ' ORDER BY position)
            FROM (SELECT * FROM mt o WHERE o.position <> b.position AND o.accuracy IS NOT NULL
                  AND (b.accuracy - o.accuracy) * 100 < 5 ORDER BY o.position LIMIT 3)), '') AS alternatives,
  {_next_sql("b.accuracy", 0.8, M.NEXT_CLASSIFICATION)} AS next_steps
FROM (SELECT * FROM mt WHERE accuracy > -1 ORDER BY accuracy DESC, position LIMIT 1) b""", *_cls_table_sql())


@register("recommendation", _recommend_cls_sql())
def q_recommendation(spark, sf):
    return M.recommend(classification_table(spark, sf), "classification", folds=FOLDS)


def _recommend_reg_sql():
    size = ("CASE WHEN (SELECT count(*) FROM lineitem) < 1000 THEN 'Small dataset detected - consider simpler models or data augmentation' "
            "WHEN (SELECT count(*) FROM lineitem) > 100000 THEN 'Large dataset - gradient boosting or deep learning could improve results' END")
    v = _fmt("b.r2", 3)
    perf = (f"CASE WHEN b.r2 >= 0.9 THEN 'Excellent fit (R² = ' || {v} || ')' "
            f"WHEN b.r2 >= 0.7 THEN 'Strong fit (R² = ' || {v} || ')' "
            f"WHEN b.r2 >= 0.5 THEN 'Moderate fit (R² = ' || {v} || ')' "
            f"ELSE 'Weak fit (R² = ' || {v} || ') - consider feature engineering' END")
    truthy = "(b.cv_mean IS NOT NULL AND b.cv_mean <> 0 AND b.cv_std IS NOT NULL AND b.cv_std <> 0)"
    cv = (f"CASE WHEN {truthy} AND b.cv_std < 0.05 THEN 'Highly stable across 3-fold CV (std = ' || {_fmt('b.cv_std', 4)} || ')' "
          f"WHEN {truthy} AND b.cv_std < 0.1 THEN 'Moderately stable across CV folds (std = ' || {_fmt('b.cv_std', 4)} || ')' "
          f"WHEN {truthy} THEN 'High variance detected - consider more data or regularization' END")
    return sql_with(f"""
SELECT b.model AS best_model, round_even(b.r2, 4) AS best_score, 'R2 Score' AS primary_metric,
  concat_ws(' | ', {perf}, 'Prediction error: RMSE = ' || {_fmt('b.rmse', 4)}, {cv}, {size}) AS reasoning,
  coalesce((SELECT string_agg(model || ' (within ' || {_pct1('(b.r2 - r2) * 100')} || '% of best)', '; ' ORDER BY position)
            FROM (SELECT * FROM rt o WHERE o.position <> b.position AND o.r2 IS NOT NULL
                  AND (b.r2 - o.r2) * 100 < 5 ORDER BY o.position LIMIT 3)), '') AS alternatives,
  {_next_sql("b.r2", 0.85, M.NEXT_REGRESSION)} AS next_steps
FROM (SELECT * FROM rt WHERE r2 > -1 ORDER BY r2 DESC, position LIMIT 1) b""", *_reg_table_sql())


@register("recommendation_regression", _recommend_reg_sql())
def q_recommendation_regression(spark, sf):
    return M.recommend(regression_table(spark, sf), "regression", folds=FOLDS)


# --- J7 ----------------------------------------------------------------------

_ORD_RULE = "CASE WHEN o_totalprice > 250000 THEN '1-URGENT' ELSE '5-LOW' END"


@register("prediction_sample", f"""
SELECT o_orderkey, o_orderpriority AS actual, {_ORD_RULE} AS predicted FROM orders ORDER BY o_orderkey LIMIT 100""")
def q_prediction_sample(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("label"),
                                           F.expr(_ORD_RULE).alias("prediction"))
    return M.prediction_sample(o, ["o_orderkey"], 100)


# --- step 7: features --------------------------------------------------------

_TARGETS = ["l_returnflag", "l_extendedprice", "l_linenumber"]


@register("detect_task", " UNION ALL ".join(
    f"SELECT '{t}' AS target, {str(t != 'l_returnflag').lower()} AS is_numeric, count(DISTINCT {t}) AS unique_values, "
    f"CASE WHEN {str(t != 'l_returnflag').lower()} AND count(DISTINCT {t}) > 12 THEN 'regression' ELSE 'classification' END AS task "
    f"FROM lineitem" for t in _TARGETS))
def q_detect_task(spark, sf):
    li = table(spark, sf, "lineitem")
    out = None
    for t in _TARGETS:
        d = FE.detect_task(li, t)
        out = d if out is None else out.unionByName(d)
    return out


@register("encode_labels", sql_with("""
SELECT l_orderkey, l_linenumber,
  CAST(dense_rank() OVER (ORDER BY coalesce(l_returnflag, 'Missing')) - 1 AS DOUBLE) AS l_returnflag,
  CAST(dense_rank() OVER (ORDER BY l_linestatus) - 1 AS DOUBLE) AS l_linestatus
FROM dirty_lineitem""", DIRTY_LINEITEM_SQL))
def q_encode_labels(spark, sf):
    d = dirty_lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return FE.encode_labels(d, ["l_returnflag", "l_linestatus"])


@register("encode_target", sql_with("""
SELECT l_orderkey, l_linenumber, l_returnflag, CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS DOUBLE) AS target_code
FROM dirty_lineitem WHERE l_returnflag IS NOT NULL""", DIRTY_LINEITEM_SQL))
def q_encode_target(spark, sf):
    d = dirty_lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_returnflag")
    return FE.encode_target(d, "l_returnflag")


@register("target_classes", """
SELECT CAST(dense_rank() OVER (ORDER BY text) - 1 AS DOUBLE) AS code, text AS class, count(*) AS rows
FROM documents WHERE text IS NOT NULL GROUP BY text""")
def q_target_classes(spark, sf):
    """The label dictionary over a text column of long, mostly unique values."""
    return FE.target_classes(table(spark, sf, "documents").select("text", "lang"), "text")


_SPLIT_SQL = ("CASE WHEN CAST(('0x' || substr(md5(concat(CAST(o_orderkey AS VARCHAR), '42')), 1, 8)) AS BIGINT) "
              "< 858993459 THEN 'test' ELSE 'train' END")


@register("train_test_split", f"SELECT o_orderkey, o_orderstatus, {_SPLIT_SQL} AS split FROM orders")
def q_train_test_split(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return FE.train_test_split(o, "o_orderkey", 0.2, 42)


@register("split_counts", f"""
SELECT o_orderstatus, split, count(*) AS n FROM (SELECT o_orderstatus, {_SPLIT_SQL} AS split FROM orders) GROUP BY ALL""")
def q_split_counts(spark, sf):
    o = FE.train_test_split(table(spark, sf, "orders"), "o_orderkey", 0.2, 42)
    return o.groupBy("o_orderstatus", "split").agg(F.count(F.lit(1)).alias("n"))


@register("stratified_split", f"""
WITH r AS (SELECT o_orderkey, o_orderstatus,
             CAST(('0x' || substr(md5(concat(CAST(o_orderkey AS VARCHAR), '42')), 1, 8)) AS BIGINT) AS r FROM orders),
tot AS (SELECT count(*) AS t, CAST(ceil(0.2 * count(*)) AS BIGINT) AS w FROM orders),
fl AS (SELECT o_orderstatus, w, (w * count(*)) // t AS f, (w * count(*)) % t AS rest FROM orders, tot GROUP BY o_orderstatus, t, w),
quota AS (SELECT o_orderstatus, f + CASE WHEN row_number() OVER (ORDER BY rest DESC, o_orderstatus) <= w - sum(f) OVER () THEN 1 ELSE 0 END AS q FROM fl)
SELECT o_orderkey, o_orderstatus,
  CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY r, o_orderkey) <= q THEN 'test' ELSE 'train' END AS split
FROM r JOIN quota USING (o_orderstatus)""")
def q_stratified_split(spark, sf):
    return FE.stratified_split(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")


@register("confusion_matrix_missing", f"""
WITH p AS (SELECT coalesce(l_returnflag, 'Missing') AS actual, coalesce(CASE WHEN l_quantity IS NOT NULL THEN {_RULE_A} END, 'Missing') AS predicted
           FROM dirty_lineitem),
     cm AS (SELECT actual, predicted, count(*) AS n FROM p GROUP BY ALL),
     cls AS (SELECT actual AS c FROM cm UNION SELECT predicted FROM cm)
SELECT a.c AS actual, b.c AS predicted, CAST(coalesce(cm.n, 0) AS BIGINT) AS count
FROM cls a, cls b LEFT JOIN cm ON cm.actual = a.c AND cm.predicted = b.c""".replace("WITH p AS", "WITH " + DIRTY_LINEITEM_SQL.strip() + ",\np AS"))
def q_confusion_matrix_missing(spark, sf):
    d = dirty_lineitem(spark, sf)
    pred = F.when(F.col("l_quantity").isNotNull(), F.expr(_RULE_A))
    return M.confusion_matrix(d.select(F.col("l_returnflag").alias("label"), pred.alias("prediction")))


_SCALE_COLS = ["o_totalprice", "o_custkey"]


def _scale_sql(kind):
    sel = []
    for c in _SCALE_COLS:
        if kind == "standard":
            e = (f"(CAST({c} AS DOUBLE) - (SELECT avg({c}) FROM s WHERE split = 'train')) / "
                 f"coalesce(nullif((SELECT stddev_pop({c}) FROM s WHERE split = 'train'), 0), 1)")
        else:
            e = (f"(CAST({c} AS DOUBLE) - (SELECT min({c}) FROM s WHERE split = 'train')) / "
                 f"CASE WHEN (SELECT max({c}) - min({c}) FROM s WHERE split = 'train') > 0 "
                 f"THEN (SELECT max({c}) - min({c}) FROM s WHERE split = 'train') ELSE 1 END")
        sel.append(f"round_even({e}, 6) AS {c}")
    return (f"WITH s AS (SELECT o_orderkey, o_totalprice, o_custkey, {_SPLIT_SQL} AS split FROM orders) "
            f"SELECT o_orderkey, {', '.join(sel)}, split FROM s")


def _scaled(spark, sf, kind):
    o = FE.train_test_split(table(spark, sf, "orders").select("o_orderkey", *_SCALE_COLS), "o_orderkey")
    s = FE.scale(o, _SCALE_COLS, kind)
    return s.select("o_orderkey", *[F.bround(c, 6).alias(c) for c in _SCALE_COLS], "split")


@register("scale_standard", _scale_sql("standard"))
def q_scale_standard(spark, sf):
    return _scaled(spark, sf, "standard")


@register("scale_minmax", _scale_sql("minmax"))
def q_scale_minmax(spark, sf):
    return _scaled(spark, sf, "minmax")


@register("smote_class_counts", f"""
SELECT o_orderpriority AS class, count(*) AS count_before, max(count(*)) OVER () AS count_after
FROM (SELECT *, {_SPLIT_SQL} AS split FROM orders) WHERE split = 'train' GROUP BY o_orderpriority""")
def q_smote_class_counts(spark, sf):
    o = FE.train_test_split(table(spark, sf, "orders"), "o_orderkey").where(F.col("split") == "train")
    return FE.class_balance(o, "o_orderpriority")


# --- trained models (rows-only) -----------------------------------------------

from tabsense.operators import models as ML  # noqa: E402

_CLS_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus"]
_REG_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def _li_keyed(spark, sf):
    li = table(spark, sf, "lineitem")
    # (l_orderkey, l_linenumber) repeats; the split key hashes the whole row
    return li.withColumn("row_key", F.xxhash64(*li.columns))


def _classifier(spark, sf, names, **kw):
    run = ML.train_models(_li_keyed(spark, sf), "l_returnflag", _CLS_FEATURES, "classification", names, key="row_key", **kw)
    return run.metrics.select("model", "position", *[F.bround(c, 4).alias(c) for c in
                                                     ("accuracy", "precision", "recall", "f1", "cv_mean", "cv_std")], "n")


def _regressor(spark, sf, names):
    run = ML.train_models(_li_keyed(spark, sf), "l_extendedprice", _REG_FEATURES, "regression", names, key="row_key")
    return run.metrics.select("model", "position", *[round_sig(c, 4).alias(c) for c in
                                                     ("r2", "mae", "mse", "rmse", "cv_mean", "cv_std")], "n")


@register("train_classifier")
def q_train_classifier(spark, sf):
    return _classifier(spark, sf, ["Logistic Regression", "Decision Tree"])


@register("train_classifier_ensembles")
def q_train_classifier_ensembles(spark, sf):
    return _classifier(spark, sf, ["Random Forest", "Gradient Boosting"])


@register("train_classifier_balanced")
def q_train_classifier_balanced(spark, sf):
    return _classifier(spark, sf, ["Decision Tree"], balance=True)


@register("train_regressor")
def q_train_regressor(spark, sf):
    return _regressor(spark, sf, ["Linear Regression", "Ridge Regression", "Decision Tree"])


@register("train_regressor_ensembles")
def q_train_regressor_ensembles(spark, sf):
    return _regressor(spark, sf, ["Random Forest", "Gradient Boosting"])


_ONE_X = "CAST(l_quantity AS DOUBLE)"
_RANK = "CAST(('0x' || substr(md5(concat(CAST({k} AS VARCHAR), '{s}')), 1, 8)) AS BIGINT)"


@register("linear_one_feature", f"""
WITH s AS (SELECT {_ONE_X} AS x, l_extendedprice AS y,
             {_RANK.format(k="l_orderkey * 100 + l_linenumber", s=42)} < 858993459 AS held,
             {_RANK.format(k="l_orderkey * 100 + l_linenumber", s=43)} % 3 AS fold FROM lineitem),
fit AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM s WHERE NOT held),
met AS (SELECT 1 - avg((y - a * x - b) * (y - a * x - b)) / var_pop(y) AS r2, avg(abs(y - a * x - b)) AS mae, count(*) AS n FROM s, fit WHERE held),
folds AS (SELECT f.fold, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM s, (VALUES (0), (1), (2)) f(fold) WHERE NOT held AND s.fold <> f.fold GROUP BY f.fold),
cv AS (SELECT s.fold, 1 - avg((y - a * x - b) * (y - a * x - b)) / var_pop(y) AS r2 FROM s JOIN folds USING (fold) WHERE NOT held GROUP BY s.fold)
SELECT 'Linear Regression' AS model, round_even(r2, 6) AS r2, round_even(mae, 4) AS mae,
  (SELECT round_even(avg(cv.r2), 6) FROM cv) AS cv_mean, n FROM met""")
def q_linear_one_feature(spark, sf):
    """A one-feature fit, its held-out error and its cross-validation against DuckDB's closed form."""
    li = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("key"),
                                             F.col("l_quantity").cast("double").alias("l_quantity"), "l_extendedprice")
    run = ML.train_models(li, "l_extendedprice", ["l_quantity"], "regression", ["Linear Regression"], key="key")
    return run.metrics.select("model", F.bround("r2", 6).alias("r2"), F.bround("mae", 4).alias("mae"), F.bround("cv_mean", 6).alias("cv_mean"), "n")


@register("linear_two_features", f"""
WITH s AS (SELECT CAST(l_quantity AS DOUBLE) AS x1, l_discount * 100 AS x2, l_extendedprice AS y,
             {_RANK.format(k="l_orderkey * 100 + l_linenumber", s=42)} < 858993459 AS held,
             {_RANK.format(k="l_orderkey * 100 + l_linenumber", s=43)} % 3 AS fold FROM lineitem),
t AS (SELECT f.fit, x1, x2, y FROM s, (VALUES (-1), (0), (1), (2)) f(fit) WHERE NOT held AND s.fold <> f.fit),
g AS (SELECT fit, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, count(*) * var_pop(x1) AS s11, count(*) * var_pop(x2) AS s22,
        count(*) * covar_pop(x1, x2) AS s12, count(*) * covar_pop(x1, y) AS s1y, count(*) * covar_pop(x2, y) AS s2y FROM t GROUP BY fit),
w AS (SELECT fit, model, position, m1, m2, my, ((s22 + a) * s1y - s12 * s2y) / ((s11 + a) * (s22 + a) - s12 * s12) AS b1,
        ((s11 + a) * s2y - s12 * s1y) / ((s11 + a) * (s22 + a) - s12 * s12) AS b2
      FROM g, (VALUES ('Linear Regression', 0, 0.0), ('Ridge Regression', 1, 1.0)) k(model, position, a)),
e AS (SELECT model, position, fit, held, y, y - my - b1 * (x1 - m1) - b2 * (x2 - m2) AS err
      FROM s JOIN w ON (s.held AND w.fit = -1) OR (NOT s.held AND w.fit = s.fold)),
r AS (SELECT model, position, fit, 1 - avg(err * err) / var_pop(y) AS r2, avg(abs(err)) AS mae, count(*) AS n FROM e GROUP BY ALL)
SELECT model, CAST(position AS INTEGER) AS position, round_even(any_value(r2) FILTER (WHERE fit = -1), 6) AS r2, round_even(any_value(mae) FILTER (WHERE fit = -1), 4) AS mae,
  round_even(avg(r2) FILTER (WHERE fit >= 0), 6) AS cv_mean, round_even(stddev_pop(r2) FILTER (WHERE fit >= 0), 6) AS cv_std,
  any_value(n) FILTER (WHERE fit = -1) AS n FROM r GROUP BY model, position""")
def q_linear_two_features(spark, sf):
    """Least squares and ridge on two features, held-out error and cross-validation, against DuckDB's closed form."""
    li = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("key"), F.col("l_quantity").cast("double").alias("l_quantity"),
                                             (F.col("l_discount") * 100).alias("discount_percent"), "l_extendedprice")
    run = ML.train_models(li, "l_extendedprice", ["l_quantity", "discount_percent"], "regression", ["Linear Regression", "Ridge Regression"], key="key", scaling="none")
    return run.metrics.select("model", "position", F.bround("r2", 6).alias("r2"), F.bround("mae", 4).alias("mae"), F.bround("cv_mean", 6).alias("cv_mean"),
                              F.bround("cv_std", 6).alias("cv_std"), "n")


@register("feature_importance")
def q_feature_importance(spark, sf):
    run = ML.train_models(_li_keyed(spark, sf), "l_returnflag", _CLS_FEATURES, "classification",
                          ["Decision Tree"], key="row_key")
    return ML.feature_importance(run, "Decision Tree")


@register("cross_validate")
def q_cross_validate(spark, sf):
    run = ML.train_models(_li_keyed(spark, sf), "l_extendedprice", _REG_FEATURES, "regression",
                          ["Linear Regression"], key="row_key", cv_folds=5)
    return run.metrics.select("model", "cv_mean", "cv_std")


@register("smote_quota_ranges", f"""
WITH train AS (SELECT * FROM orders WHERE {_SPLIT_SQL} = 'train'),
c AS (SELECT o_orderpriority AS class, count(*) AS n FROM train GROUP BY o_orderpriority)
SELECT class, max(n) OVER () AS rows_after, max(n) OVER () - n AS synthetic_rows, max(n) OVER () - n AS rows_inside FROM c""")
def q_smote_quota_ranges(spark, sf):
    """Per class: rows after balancing, synthetic ones, and those inside the ranges of the class's own cells."""
    o = FE.train_test_split(table(spark, sf, "orders"), "o_orderkey").where(F.col("split") == "train")
    cols = ["o_totalprice", "o_custkey"]
    done = FE.smote(o, "o_orderpriority", cols, k=5)
    ranges = o.groupBy(F.col("o_orderpriority").alias("class")).agg(
        *[f(c).cast("double").alias(f"{n}_{c}") for c in cols for n, f in (("a", F.min), ("b", F.max))])
    inside = F.lit(True)
    for c in cols:  # the margin is the rounding of x + u * (partner - x)
        inside = inside & F.col(c).between(F.col(f"a_{c}") - F.abs(f"a_{c}") * 1e-12, F.col(f"b_{c}") + F.abs(f"b_{c}") * 1e-12)
    return done.join(F.broadcast(ranges), F.col("o_orderpriority") == F.col("class")).groupBy("class").agg(
        F.count(F.lit(1)).alias("rows_after"), F.count_if("synthetic").alias("synthetic_rows"),
        F.count_if(F.col("synthetic") & inside).alias("rows_inside"))


@register("smote_rows")
def q_smote_rows(spark, sf):
    """Training rows of orders rebalanced on o_orderpriority (rows-only;
    the class quotas themselves are checked by ``smote_class_counts``)."""
    o = FE.train_test_split(table(spark, sf, "orders"), "o_orderkey").where(F.col("split") == "train")
    return FE.smote(o, "o_orderpriority", ["o_totalprice", "o_custkey"], k=5)


# --- model blocks of the summary (M1) and the report (M2) -----------------------

from tabsense.operators import profile as PR  # noqa: E402
from tabsense.operators import reporting as RP  # noqa: E402

_IMP_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _stand_in_importances(spark, sf):
    """|correlation| of each feature with the price, standing in for a model's importances so that DuckDB can check the lines."""
    cols = [*_IMP_FEATURES, "l_extendedprice"]
    pairs = PR.correlation_pairs(table(spark, sf, "lineitem"), cols, digits=None).where(F.col("variable_2") == "l_extendedprice")
    return pairs.select(F.col("variable_1").alias("feature"), F.abs("correlation").alias("importance"))


_IMP_SQL = "imp AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS rk FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, abs(corr({c}, l_extendedprice)) AS importance FROM lineitem" for c in _IMP_FEATURES) + "))"
_BEST_SQL = "b AS (SELECT * FROM mt ORDER BY accuracy DESC, position LIMIT 1)"


@register("report_model_section", sql_with("""
SELECT CAST(4 AS INTEGER) AS section, CAST(line_no AS INTEGER) AS line_no, line FROM (
  SELECT 400 AS line_no, '## 4. Machine Learning Modeling' AS line UNION ALL SELECT 401, ''
  UNION ALL SELECT 402, '**Target Variable:** `l_returnflag`  ' UNION ALL SELECT 403, '**Task Type:** `Classification`  '
  UNION ALL SELECT 404, '**Best Algorithm:** `' || model || '`' FROM b UNION ALL SELECT 405, ''
  UNION ALL SELECT 406, '| Metric | Value |' UNION ALL SELECT 407, '|--------|-------|'
  UNION ALL SELECT 408, '| Accuracy | ' || printf('%.4f', accuracy) || ' |' FROM b
  UNION ALL SELECT 409, '| Precision | ' || printf('%.4f', precision) || ' |' FROM b
  UNION ALL SELECT 410, '| Recall | ' || printf('%.4f', recall) || ' |' FROM b
  UNION ALL SELECT 411, '| F1-Score | ' || printf('%.4f', f1) || ' |' FROM b
  UNION ALL SELECT 412, '| cv_mean | ' || printf('%.4f', cv_mean) || ' |' FROM b
  UNION ALL SELECT 413, '| cv_std | ' || printf('%.4f', cv_std) || ' |' FROM b
  UNION ALL SELECT 420, '' UNION ALL SELECT 421, '### Feature Importances' UNION ALL SELECT 422, ''
  UNION ALL SELECT 423, '| Feature | Importance |' UNION ALL SELECT 424, '|---------|------------|'
  UNION ALL SELECT 424 + rk, '| ' || feature || ' | ' || printf('%.4f', importance) || ' |' FROM imp WHERE rk <= 10
  UNION ALL SELECT 440, '')""", *_cls_table_sql(), _BEST_SQL, _IMP_SQL))
def q_report_model_section(spark, sf):
    best = M.best_model(classification_table(spark, sf), "accuracy")
    return RP.model_section(best, "l_returnflag", "classification", _stand_in_importances(spark, sf), 4) \
        .select(F.col("section").cast("int"), F.col("line_no").cast("int"), "line")


@register("summary_model_block", sql_with(f"""
SELECT CAST(line_no AS INTEGER) AS line_no, line FROM (
  SELECT 500 AS line_no, '=== Machine Learning Modeling Summary ===' AS line UNION ALL SELECT 501, 'Target Column: l_returnflag'
  UNION ALL SELECT 502, 'Features Used: {", ".join(_IMP_FEATURES)}' UNION ALL SELECT 504, 'Task Type: Classification'
  UNION ALL SELECT 505, 'Best Trained Model: ' || model FROM b UNION ALL SELECT 506, 'Model Performance Metrics on Test Set:'
  UNION ALL SELECT 507, '  Accuracy: ' || printf('%.4f', accuracy) FROM b
  UNION ALL SELECT 508, '  Precision: ' || printf('%.4f', precision) FROM b
  UNION ALL SELECT 509, '  Recall: ' || printf('%.4f', recall) FROM b
  UNION ALL SELECT 510, '  F1-Score: ' || printf('%.4f', f1) FROM b
  UNION ALL SELECT 511, '  cv_mean: ' || printf('%.4f', cv_mean) FROM b
  UNION ALL SELECT 550, 'Top Feature Importances (Predictive Power):'
  UNION ALL SELECT 550 + rk, '  ' || feature || ': ' || printf('%.4f', importance) FROM imp WHERE rk <= 5)""",
    *_cls_table_sql(), _BEST_SQL, _IMP_SQL))
def q_summary_model_block(spark, sf):
    best = M.best_model(classification_table(spark, sf), "accuracy")
    return RP.summary_blocks(best=best, target="l_returnflag", features=_IMP_FEATURES, importances=_stand_in_importances(spark, sf)) \
        .select(F.col("line_no").cast("int"), "line")


@register("model_details", sql_with("""
SELECT CAST(line_no AS INTEGER) AS line_no, line FROM (
  SELECT 600 AS line_no, '=== MODELING RESULTS DETAILS ===' AS line
  UNION ALL SELECT 601, 'Best performing model: ' || model FROM b
  UNION ALL SELECT 602, 'Task: classification - predicting ''l_returnflag'''
  UNION ALL SELECT 603, 'Best model accuracy: ' || printf('%.4f', accuracy) || ' (' || printf('%.1f', accuracy * 100) || '%)' FROM b
  UNION ALL SELECT 604, 'Best model F1-Score: ' || printf('%.4f', f1) FROM b
  UNION ALL SELECT 605, 'Performance: ' || CASE WHEN accuracy >= 0.9 THEN 'EXCELLENT - Model is highly accurate'
    WHEN accuracy >= 0.8 THEN 'GOOD - Model performs well' WHEN accuracy >= 0.7 THEN 'MODERATE - Model has reasonable accuracy'
    ELSE 'NEEDS IMPROVEMENT - Consider feature engineering or more data' END FROM b
  UNION ALL SELECT 606, 'Top 3 influential features: ' || string_agg(feature, ', ' ORDER BY rk) FROM imp WHERE rk <= 3)""",
    *_cls_table_sql(), _BEST_SQL, _IMP_SQL))
def q_model_details(spark, sf):
    best = M.best_model(classification_table(spark, sf), "accuracy")
    return RP.model_details(best, "l_returnflag", "classification", _stand_in_importances(spark, sf)).select(F.col("line_no").cast("int"), "line")


def _full_context_sql():
    nums, cats = ["p_partkey", "p_size", "p_retailprice"], ["p_name", "p_brand", "p_type"]

    def cell(e, label):
        return f"'{label}=' || printf('%.2f', round_even_sig({e}, 2))"

    def numeric(i, c):
        x = f"CAST({c} AS DOUBLE)"
        cells = [cell(f"CAST(count({c}) AS DOUBLE)", "count"), cell(f"avg({x})", "mean"), cell(f"stddev_samp({x})", "std"), cell(f"min({x})", "min"),
                 *[cell(f"quantile_cont({x}, {p})", label) for p, label in ((0.25, "25%"), (0.5, "50%"), (0.75, "75%"))], cell(f"max({x})", "max")]
        return f"SELECT {1001 + i}, '{c}: ' || " + " || ', ' || ".join(cells) + " FROM part"

    values = " UNION ALL ".join(f"SELECT {i} AS pos, '{c}' AS col, {c} AS v, count(*) AS n FROM part WHERE {c} IS NOT NULL GROUP BY {c}" for i, c in enumerate(cats))
    lines = ["SELECT 0 AS line_no, 'Shape: ' || CAST(count(*) AS VARCHAR) || ' rows × 6 columns' AS line FROM part",
             "SELECT 1, 'Columns: p_partkey, p_name, p_brand, p_type, p_size, p_retailprice'", "SELECT 1000, 'Numeric Statistics:'",
             *[numeric(i, c) for i, c in enumerate(nums)], "SELECT 2000, 'Categorical Columns:'",
             "SELECT 2001 + pos, '  ' || col || ': {' || string_agg('''' || v || ''': ' || CAST(n AS VARCHAR), ', ' ORDER BY rk) || '}' "
             f"FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) AS rk FROM ({values})) WHERE rk <= 3 GROUP BY pos, col",
             "SELECT 4000, 'Machine Learning Model: ' || model FROM b", "SELECT 4001, 'Predicting Target: l_returnflag'", "SELECT 4002, 'Task type: classification'",
             "SELECT 4003, 'Model Performance Metrics:'",
             *[f"SELECT {4004 + k}, '  {label}: ' || printf('%.4f', {c}) FROM b" for k, (c, label) in enumerate(RP._scalars("classification"))]]
    return sql_with("SELECT CAST(line_no AS INTEGER) AS line_no, line FROM (" + " UNION ALL ".join(lines) + ")", *_cls_table_sql(), _BEST_SQL)


@register("full_context", _full_context_sql())
def q_full_context(spark, sf):
    best = M.best_model(classification_table(spark, sf), "accuracy")
    return RP.full_context(table(spark, sf, "part"), best=best, target="l_returnflag")
