"""Model evaluation and ranking.

Inputs are prediction tables (label, prediction[, segment columns]) or
metric tables (one row per model[, segment]).  The only pass over the rows
is one ``groupBy(label, prediction)``; everything after it works on tables
of at most classes^2 rows per segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsense.functions.columns import q
from tabsense.functions.stats import fixed


def _by(by):
    return list(by or [])


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                           by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 (a class
    with no predicted or no true rows scores 0, as with zero_division=0).

    ``weight`` names a row-count column when ``pred`` is already a table of
    (label, prediction, count) cells, e.g. one confusion table shared by an
    overall and a per-fold evaluation."""
    by = _by(by)
    n_rows = F.count(F.lit(1)) if weight is None else F.sum(q(weight))
    cm = pred.groupBy(*[q(c) for c in by], q(label).alias("_l"), q(prediction).alias("_p")) \
        .agg(n_rows.alias("_n"))
    # each confusion cell counts once for its true class (support, hits) and
    # once for its predicted class: one groupBy per class, no join
    hit = F.when(F.col("_l") == F.col("_p"), F.col("_n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("_l").alias("_c"), F.col("_n").alias("s"), hit.alias("t"), zero.alias("d")),
        F.struct(F.col("_p").alias("_c"), zero.alias("s"), zero.alias("t"), F.col("_n").alias("d")))
    per = cm.select(*by, F.inline(sides)).groupBy(*by, "_c").agg(
        F.sum("s").alias("support"), F.sum("t").alias("tp"), F.sum("d").alias("predicted"))
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    per = per.withColumn("_p", p).withColumn("_r", r).withColumn(
        "_f", F.when(F.col("_p") + F.col("_r") > 0,
                     2 * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r"))).otherwise(F.lit(0.0)))
    n = F.sum("support")
    return per.groupBy(*by).agg(
        (F.sum("tp") / n).alias("accuracy"),
        (F.sum(F.col("support") * F.col("_p")) / n).alias("precision"),
        (F.sum(F.col("support") * F.col("_r")) / n).alias("recall"),
        (F.sum(F.col("support") * F.col("_f")) / n).alias("f1"),
        n.cast("bigint").alias("n"))


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                       by: list[str] | None = None) -> DataFrame:
    """R2 (1 - SSE/SST; 1 or 0 for a constant label), MAE, MSE, RMSE."""
    by = _by(by)
    y, yh = q(label).cast("double"), q(prediction).cast("double")
    e = y - yh
    agg = pred.where(y.isNotNull() & yh.isNotNull()).groupBy(*[q(c) for c in by]).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
        F.var_pop(y).alias("_vy"))
    r2 = (F.when(F.col("_vy") > 0, 1 - F.col("mse") / F.col("_vy"))
          .when(F.col("mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return agg.select(*by, r2.alias("r2"), "mae", "mse", F.sqrt("mse").alias("rmse"), "n")


MAX_CLASSES = 2_000   # a grid of more is no confusion matrix: the label is not categorical
NO_CLASS = "Missing"


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(actual, predicted, count) over the full grid of classes seen
    in either column (sorted), zeros included; a NULL is the class ``Missing``,
    so the cells sum to the rows.  The grid is built from the class list (an
    error beyond ``MAX_CLASSES``) with two ``explode``s."""
    text = lambda c: F.coalesce(q(c).cast("string"), F.lit(NO_CLASS))
    cm = pred.groupBy(text(label).alias("actual"), text(prediction).alias("predicted")).agg(F.count(F.lit(1)).alias("count"))
    classes = cm.select(F.explode(F.array("actual", "predicted")).alias("c")).distinct().limit(MAX_CLASSES + 1) \
        .agg(F.sort_array(F.collect_list("c")).alias("cs"))
    classes = classes.select(F.when(F.size("cs") > MAX_CLASSES, F.raise_error(F.lit(f"more than {MAX_CLASSES} classes: the label is not categorical")))
                             .otherwise(F.col("cs")).alias("cs"))
    grid = classes.select(F.explode("cs").alias("actual"), "cs") \
        .select("actual", F.explode("cs").alias("predicted"))
    return grid.join(cm, ["actual", "predicted"], "left") \
        .select("actual", "predicted", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def best_model(metrics: DataFrame, score: str, by: list[str] | None = None) -> DataFrame:
    """Highest ``score`` per segment; the earliest ``position`` wins ties."""
    by = _by(by)
    w = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), F.col("position"))
    return metrics.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") == 1).drop("_rk")


def prediction_sample(pred: DataFrame, key: list[str], n: int = 100,
                      label: str = "label", prediction: str = "prediction") -> DataFrame:
    """The first ``n`` (actual, predicted) pairs in ``key`` order."""
    return pred.orderBy(*[q(k) for k in key]).limit(n) \
        .select(*[q(k) for k in key], q(label).alias("actual"), q(prediction).alias("predicted"))


CLASSIFICATION_SERIES = [("accuracy", "Accuracy"), ("precision", "Precision"), ("recall", "Recall"),
                         ("f1", "F1-Score")]
REGRESSION_SERIES = [("r2", "R2 Score"), ("mae", "MAE"), ("rmse", "RMSE")]
# every scalar metric of the comparison table
CLASSIFICATION_SCALARS = ["accuracy", "precision", "recall", "f1", "cv_mean", "cv_std"]
REGRESSION_SCALARS = ["r2", "mae", "mse", "rmse", "cv_mean", "cv_std"]


def model_comparison(metrics: DataFrame, task: str, by: list[str] | None = None, long: bool = True) -> DataFrame:
    """L4 (long: model, metric, value) and J8 (wide: every scalar metric, 4 dp,
    and the CV score, given only where the CV mean is non-zero)."""
    by = _by(by)
    series = CLASSIFICATION_SERIES if task == "classification" else REGRESSION_SERIES
    if long:
        arr = F.array(*[F.struct(F.lit(label).alias("metric"), F.bround(F.col(c), 4).alias("value"))
                        for c, label in series])
        return metrics.select(*by, "model", "position", F.explode(arr).alias("s")).select(
            *by, "model", "position", "s.metric", "s.value")
    cv = F.when(F.col("cv_mean").isNotNull() & (F.col("cv_mean") != 0), F.bround("cv_mean", 4))
    scalars = CLASSIFICATION_SCALARS if task == "classification" else REGRESSION_SCALARS
    return metrics.select(*by, "model", "position", *[F.bround(c, 4).alias(c) for c in scalars],
                          cv.alias("cv_score"))


# ---------------------------------------------------------------------------
# Recommendation rules (J9).  Fixed values: bands and wording of the
# reference's rules, kept verbatim apart from decoration.
# classification accuracy bands 0.9 / 0.8 / 0.7; F1 bands 0.85 / 0.7;
# regression R2 bands 0.9 / 0.7 / 0.5; balance |precision - recall| < 0.05;
# CV std bands 0.05 / 0.1; dataset size < 1,000 small, > 100,000 large;
# alternatives within 5 points of the best, at most 3.
TXT_ACC = ["Excellent predictive power ({v}% accuracy)", "Strong predictive power ({v}% accuracy)",
           "Moderate predictive power ({v}% accuracy)", "Room for improvement ({v}% accuracy)"]
TXT_BALANCED = "Well-balanced between precision and recall"
TXT_TRADEOFF = "Trade-off detected: Precision={p}, Recall={r}"
TXT_F1 = ["Excellent F1-score - great overall performance", "Good F1-score - reliable predictions"]
TXT_R2 = ["Excellent fit (R² = {v})", "Strong fit (R² = {v})", "Moderate fit (R² = {v})",
          "Weak fit (R² = {v}) - consider feature engineering"]
TXT_RMSE = "Prediction error: RMSE = {v}"
TXT_CV = ["Highly stable across {k}-fold CV (std = {v})", "Moderately stable across CV folds (std = {v})",
          "High variance detected - consider more data or regularization"]
TXT_SMALL = "Small dataset detected - consider simpler models or data augmentation"
TXT_LARGE = "Large dataset - gradient boosting or deep learning could improve results"
TXT_ALT = "{m} (within {v}% of best)"
# next steps: classification below 0.8, regression below 0.85, either from 0.85 on
NEXT_CLASSIFICATION = ["Feature Engineering: Create interaction features or polynomial features",
                       "Hyperparameter Tuning: Use GridSearchCV or Optuna for optimization",
                       "Ensemble Methods: Try stacking or voting classifiers"]
NEXT_REGRESSION = ["Outlier Investigation: Review extreme values affecting predictions",
                   "Additional Features: Consider external data sources",
                   "Model Complexity: Try XGBoost or LightGBM with tuning"]
NEXT_GOOD = ["Model Deployment: Ready for production deployment",
             "Model Documentation: Document feature requirements and preprocessing",
             "Monitoring Setup: Implement drift detection for production"]
# ---------------------------------------------------------------------------


def _fmt(c: Column, decimals: int) -> Column:
    """Fixed-decimals text."""
    return fixed(c, decimals)


def _tpl(template: str, **parts: Column) -> Column:
    """Fill a ``{name}`` template with column texts."""
    pieces, rest = [], template
    while "{" in rest:
        a, b = rest.split("{", 1)
        name, rest = b.split("}", 1)
        if a:
            pieces.append(F.lit(a))
        pieces.append(parts[name])
    if rest:
        pieces.append(F.lit(rest))
    return F.concat(*pieces)


def recommend(metrics: DataFrame, task: str, n_rows: int | None = None, folds: int = 5,
              by: list[str] | None = None) -> DataFrame:
    """One row per segment with the best model (score must exceed -1;
    first on ties), its score, the reasoning lines, up to three alternatives
    and the next steps, joined with `` | `` and ``; ``.  The number of rows is
    the metrics' own ``n`` unless given."""
    by = _by(by)
    score = "accuracy" if task == "classification" else "r2"
    primary = "Accuracy" if task == "classification" else "R2 Score"
    # annotate every model row with its segment's best model (window over the
    # metrics table: one row per model, bounded)
    full = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), F.col("position")) \
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ok = F.col(score) > -1
    ann = metrics.withColumn("best_model", F.first(F.when(ok, F.col("model")), ignorenulls=True).over(full)) \
        .withColumn("best_score", F.first(F.when(ok, F.col(score)), ignorenulls=True).over(full)) \
        .withColumn("_bp", F.first(F.when(ok, F.col("position")), ignorenulls=True).over(full)) \
        .where(F.col("best_model").isNotNull())
    best_rows = ann.where(F.col("position") == F.col("_bp"))
    if task == "classification":
        a, f1, p, r = F.col("accuracy"), F.col("f1"), F.col("precision"), F.col("recall")
        pct = _fmt(a * 100, 1)
        perf = (F.when(a >= 0.9, _tpl(TXT_ACC[0], v=pct)).when(a >= 0.8, _tpl(TXT_ACC[1], v=pct))
                .when(a >= 0.7, _tpl(TXT_ACC[2], v=pct)).otherwise(_tpl(TXT_ACC[3], v=pct)))
        bal = F.when(F.abs(p - r) < 0.05, F.lit(TXT_BALANCED)).otherwise(
            _tpl(TXT_TRADEOFF, p=_fmt(p, 3), r=_fmt(r, 3)))
        f1n = F.when(f1 >= 0.85, F.lit(TXT_F1[0])).when(f1 >= 0.7, F.lit(TXT_F1[1]))
        lines = [perf, bal, f1n]
    else:
        r2, rmse = F.col("r2"), F.col("rmse")
        v = _fmt(r2, 3)
        perf = (F.when(r2 >= 0.9, _tpl(TXT_R2[0], v=v)).when(r2 >= 0.7, _tpl(TXT_R2[1], v=v))
                .when(r2 >= 0.5, _tpl(TXT_R2[2], v=v)).otherwise(_tpl(TXT_R2[3], v=v)))
        lines = [perf, _tpl(TXT_RMSE, v=_fmt(rmse, 4))]
    cm, cs = F.col("cv_mean"), F.col("cv_std")
    truthy = cm.isNotNull() & (cm != 0) & cs.isNotNull() & (cs != 0)
    cvn = F.when(truthy & (cs < 0.05), _tpl(TXT_CV[0], k=F.lit(str(folds)), v=_fmt(cs, 4))) \
        .when(truthy & (cs < 0.1), _tpl(TXT_CV[1], v=_fmt(cs, 4))).when(truthy, F.lit(TXT_CV[2]))
    rows = F.col("n") if n_rows is None else F.lit(n_rows)
    size = F.when(rows < 1000, TXT_SMALL).when(rows > 100000, TXT_LARGE)
    bs = F.col("best_score")
    low, weak = (0.8, NEXT_CLASSIFICATION) if task == "classification" else (0.85, NEXT_REGRESSION)
    steps = F.when(bs < low, " | ".join(weak)).when(bs >= 0.85, " | ".join(NEXT_GOOD)).otherwise("")
    lines += [cvn, size.cast("string")]
    best = best_rows.select(*by, "best_model", "best_score", F.concat_ws(" | ", *lines).alias("reasoning"), steps.alias("next_steps"))
    # alternatives: other models with a numeric score within 5 points of the best
    others = ann.where(F.col(score).isNotNull() & (F.col("position") != F.col("_bp")))
    diff = (F.col("best_score") - F.col(score)) * 100
    others = others.where(diff < 5).withColumn(
        "_rk", F.row_number().over(Window.partitionBy(*by).orderBy("position")))
    alts = others.where(F.col("_rk") <= 3).groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("position", _tpl(TXT_ALT, m=F.col("model"), v=_fmt(diff, 1))
                                              .alias("t")))).alias("_a"))
    out = best.join(alts, by, "left") if by else best.unionByName(
        alts.select(F.lit(None).cast("string").alias("best_model"), "_a"), allowMissingColumns=True)
    if not by:
        out = out.agg(F.max("best_model").alias("best_model"), F.max("best_score").alias("best_score"),
                      F.max("reasoning").alias("reasoning"), F.max("next_steps").alias("next_steps"), F.max("_a").alias("_a")) \
            .where(F.col("best_model").isNotNull())
    return out.select(*by, "best_model", F.bround("best_score", 4).alias("best_score"),
                      F.lit(primary).alias("primary_metric"), "reasoning",
                      F.coalesce(F.array_join(F.transform("_a", lambda s: s["t"]), "; "), F.lit(""))
                      .alias("alternatives"), "next_steps")
