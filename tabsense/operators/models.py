"""Model training and cross-validation with ``pyspark.ml``.

The run mirrors the reference's sequence: rows with a known target ->
categorical features filled with ``Missing`` and label-encoded -> text
target encoded (classification) -> split (exact and stratified for
classification) -> scaler fitted on the training rows -> optional class
rebalancing -> each selected estimator is
fitted, evaluated on the test rows and cross-validated on the training
rows with min(folds, 3) folds.  Every step is a distributed Spark job.

Forests and boosting grow all folds' models in the same jobs (``trees``),
linear and ridge regression come from one Gram matrix per fold (``linear``);
logistic regression and the single tree are Spark's own.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.functions.columns import normalize_nan, q
from tabsense.functions.labels import encode
from tabsense.operators import linear, trees
from tabsense.operators import metrics as M
from tabsense.operators.chartdata import md5_rank
from tabsense.operators.cleaning import MISSING_LABEL
from tabsense.operators.features import (DEFAULT_SEED, DEFAULT_TEST_SHARE, detect_task, scale, smote,
                                         stratified_split, train_test_split)
from tabsense.session import materialize

CLASSIFIERS = ("Random Forest", "Gradient Boosting", "Logistic Regression", "Decision Tree")
REGRESSORS = ("Random Forest", "Gradient Boosting", "Linear Regression", "Ridge Regression")
UNAVAILABLE = ("XGBoost", "LightGBM")
MAX_CV_FOLDS = 3            # fixed value: folds actually run = min(chosen, 3)
RIDGE_ALPHA = 1.0
ROWS_PER_TASK = 500_000     # of the rows that Spark's estimators iterate over
ROWS_AT_ONCE = 4_000_000    # up to so many, the folds are fitted beside each other (each fit holds its rows)


@dataclass(frozen=True)
class ModelOptions:
    """Sizes of the models, the same at every number of rows.

    max_depth: of a forest's or single tree's nodes (Spark allows 30);
    trees, rounds: of a forest and of boosting; max_bins: split candidates
    per feature, raised where an encoded feature has more values."""
    max_depth: int = 10
    trees: int = 100
    rounds: int = 100
    max_bins: int = 32


def make_estimator(name: str, task: str, n_train: int, seed: int = DEFAULT_SEED, options: ModelOptions = ModelOptions()):
    """Spark's estimator for one of the reference's model names that this library does not fit itself."""
    tree = dict(maxDepth=options.max_depth, maxBins=options.max_bins, seed=seed)
    if task == "classification" and name == "Logistic Regression":
        return LogisticRegression(maxIter=1000, regParam=1.0 / max(n_train, 1), elasticNetParam=0.0, standardization=False)
    if name == "Decision Tree":
        return DecisionTreeClassifier(**tree) if task == "classification" else DecisionTreeRegressor(**tree)
    raise ValueError(f"unknown model {name!r} for {task}")


@dataclass
class TrainingRun:
    metrics: DataFrame                 # one row per model (J1/J2 + cv_mean, cv_std)
    predictions: DataFrame             # model, key, label, prediction on the test rows
    models: dict = field(default_factory=dict)
    features: list = field(default_factory=list)
    task: str = "classification"
    label_classes: list | None = None  # inverse mapping of an encoded text target


def prepare(df: DataFrame, target: str, features: list[str], task: str, key: str | None,
            test: float, seed: int, scaling: str, missing: str):
    """Encode, split and scale; returns (train, test with columns ``_key, label, inputs...``, inputs, classes, bins)."""
    df = normalize_nan(df)
    data = df.where(q(target).isNotNull()).select(*[q(c) for c in features], q(target).alias("_target"),
                                                  (q(key) if key else F.xxhash64(*[q(c) for c in df.columns]))
                                                  .alias("_key"))
    cats = [c for c in features if isinstance(df.schema[c].dataType, T.StringType)]
    nums = [c for c in features if c not in cats]
    bins = 0
    if cats:
        data = data.na.fill(MISSING_LABEL, subset=cats)
        # codes are numbers, as the reference's encoder gives them: no nominal attribute, scaled or not
        data, labels = encode(data, cats, [f"{c}__idx" for c in cats])
        bins = max(labels)
    classes = None
    if task == "classification" and isinstance(df.schema[target].dataType, T.StringType):
        ti = StringIndexer(inputCol="_target", outputCol="label", stringOrderType="alphabetAsc").fit(data)
        classes = list(ti.labels)
        data = ti.transform(data)
    else:
        data = data.withColumn("label", F.col("_target").cast("double"))
    if missing == "skip":
        data = data.na.drop(subset=nums)
    elif missing == "median" and nums:
        from tabsense.operators.cleaning import impute_numeric
        data = impute_numeric(data, "median", cols=nums)
    inputs = nums + [f"{c}__idx" for c in cats]
    data = data.select("_key", "label", *[q(c).cast("double").alias(c) for c in inputs])
    if task == "classification":  # the split reads keys' ranks several times
        data = trees.written(data.withColumn("_rank", md5_rank("_key", seed)), "model-rows")
    data = materialize(stratified_split(data, "_key", "label", test, seed, "_rank") if task == "classification"
                       else train_test_split(data, "_key", test, seed))
    if scaling in ("standard", "minmax") and inputs:
        data = scale(data, inputs, scaling)
    return data.where("split = 'train'").drop("split"), data.where("split = 'test'").drop("split"), inputs, classes, bins


def train_models(df: DataFrame, target: str, features: list[str] | None = None, task: str | None = None,
                 names: list[str] | None = None, key: str | None = None, test: float = DEFAULT_TEST_SHARE,
                 seed: int = DEFAULT_SEED, scaling: str = "standard", cv_folds: int = 5,
                 missing: str = "error", balance: bool = False,
                 options: ModelOptions = ModelOptions()) -> TrainingRun:
    """Fit each selected model; metrics on the test rows, CV on
    the training rows (folds from the key hash).  ``balance`` first brings
    every class of a classification up to the largest by SMOTE (I7)."""
    features = features if features is not None else [c for c in df.columns if c != target]
    task = task or detect_task(df, target).first()["task"]
    names = names or ["Random Forest"]
    train, test_df, inputs, classes, bins = prepare(df, target, features, task, key, test, seed, scaling, missing)
    options = replace(options, max_bins=max(options.max_bins, bins))
    if balance and task == "classification":
        train = smote(train, "label", inputs, seed=seed).withColumn("_key", F.xxhash64("label", *[q(c) for c in inputs]))
    folds = min(cv_folds, MAX_CV_FOLDS)
    train = materialize(train.withColumn("fold", (md5_rank("_key", seed + 1) % folds).cast("int")).select("_key", *[q(c) for c in inputs], "label", "fold"))
    stats = train.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fold").alias("folds")).first()
    crossed = folds >= 2 and stats["folds"] == folds  # else too few rows for every fold: recorded as missing
    fitters = {"spark": _SparkFits, "trees": _TreeFits, "linear": _LinearFits}
    made: dict = {}
    preds, cv_rows, models = [], [], {}
    for pos, name in enumerate(names):
        kind = _fitted_by(name, task)
        if kind not in made:
            made[kind] = fitters[kind](train, inputs, task, folds if crossed else 0, stats["n"], seed, options)
        model, scores = made[kind].fit(name)
        models[name] = model
        preds.append(model.transform(made[kind].rows(test_df)).select(F.lit(name).alias("model"), F.lit(pos).alias("position"), "_key", "label", "prediction"))
        known = [x for x in scores if x is not None] if scores else []
        cv_rows.append((name, pos, float(np.mean(known)), float(np.std(known))) if known else (name, pos, None, None))
    all_preds = preds[0]
    for p in preds[1:]:
        all_preds = all_preds.unionByName(p)
    all_preds = materialize(all_preds)
    met = (M.classification_metrics(all_preds, by=["model", "position"]) if task == "classification"
           else M.regression_metrics(all_preds, by=["model", "position"]))
    cvdf = df.sparkSession.createDataFrame(cv_rows, "model string, position int, cv_mean double, cv_std double")
    if classes is not None:  # back to the text of the target
        text = F.array(*[F.lit(c) for c in classes])
        all_preds = all_preds.withColumns({f"{c}_text": F.element_at(text, (F.col(c) + 1).cast("int")) for c in ("label", "prediction")})
    return TrainingRun(metrics=met.join(cvdf, ["model", "position"]), predictions=all_preds, models=models,
                       features=inputs, task=task, label_classes=classes)


def _fitted_by(name: str, task: str) -> str:
    if name in UNAVAILABLE:
        raise ValueError(f"{name} is not available in this build (no external boosting library)")
    if name in ("Random Forest", "Gradient Boosting"):
        return "trees"
    if task == "regression" and name in ("Linear Regression", "Ridge Regression"):
        return "linear"
    return "spark"


class _SparkFits:
    """Fits of Spark's own estimators; cross-validation fits each fold's model beside the others."""

    def __init__(self, train, inputs, task, folds, n_train, seed, options):
        self.assemble = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error")
        # every iteration reads them: parts of equal size, as many more as there are more rows
        parts = max(train.sparkSession.sparkContext.defaultParallelism, -(-n_train // ROWS_PER_TASK))
        self.train = materialize(self.rows(train.repartition(parts)).select("features", "label", "fold"))
        self.task, self.folds, self.n_train, self.seed, self.options = task, folds, n_train, seed, options

    def rows(self, df: DataFrame) -> DataFrame:
        return self.assemble.transform(df)

    def fit(self, name: str):
        estimator = make_estimator(name, self.task, self.n_train, self.seed, self.options)
        model = Pipeline(stages=[estimator]).fit(self.train)
        if not self.folds:
            return model, None
        with ThreadPool(self.folds if self.n_train <= ROWS_AT_ONCE else 1) as pool:
            return model, pool.map(inheritable_thread_target(self.train.sparkSession)(lambda f: self._score(estimator, f)), range(self.folds))

    def _score(self, estimator, fold: int) -> float:
        """Accuracy or r2 on the rows of a fold of a fit on the others, which keeps its rows itself: they are not cached as a table too."""
        held = estimator.copy().fit(self.train.where(F.col("fold") != fold)).transform(self.train.where(F.col("fold") == fold))
        if self.task == "classification":
            return held.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
        return RegressionEvaluator(metricName="r2").evaluate(held)


class _TreeFits:
    """Forests and boosting on rows that are binned once."""

    def __init__(self, train, inputs, task, folds, n_train, seed, options):
        self.labels = None
        if task == "classification":
            found = [r[0] for r in train.select("label").distinct().limit(M.MAX_CLASSES + 1).collect()]
            if len(found) > M.MAX_CLASSES:
                raise ValueError(f"more than {M.MAX_CLASSES} classes: the target is not categorical")
            self.labels = np.array(sorted(found), np.float64)
        self.cuts = trees.cut_points(train, inputs, options.max_bins)
        self.binned = trees.binned(train, inputs, self.cuts, self.labels)
        self.inputs, self.folds, self.seed, self.options = inputs, folds, seed, options

    def rows(self, df: DataFrame) -> DataFrame:
        return df

    def fit(self, name: str):
        shape = (self.binned, self.inputs, self.cuts, self.labels, self.folds)
        if name == "Random Forest":
            model = trees.forest(*shape, self.options.trees, self.options.max_depth, self.seed)
        else:
            model = trees.boosting(*shape, self.options.rounds, self.seed)
        if not self.folds:
            return model, None
        held = model.held_out(self.binned)
        met = M.classification_metrics(held, by=["fold"], weight="n") if self.labels is not None else M.regression_metrics(held, by=["fold"])
        return model, [r[0] for r in met.select("accuracy" if self.labels is not None else "r2").collect()]  # one row per fold


class _LinearFits:
    """Least squares from the folds' Gram matrices, summed once for all models."""

    def __init__(self, train, inputs, task, folds, n_train, seed, options):
        self.inputs, self.folds = inputs, folds
        self.grams, self.shift = linear.grams(train, inputs, max(folds, MAX_CV_FOLDS))

    def rows(self, df: DataFrame) -> DataFrame:
        return df

    def fit(self, name: str):
        model, scores = linear.fit(self.grams, self.shift, self.inputs, RIDGE_ALPHA if name == "Ridge Regression" else 0.0)
        return model, scores if self.folds else None


def feature_importance(run: TrainingRun, model_name: str, k: int | None = None) -> DataFrame:
    """(feature, importance) of a tree model, descending, the first ``k`` if given."""
    spark = run.metrics.sparkSession
    model = run.models[model_name]
    if hasattr(model, "importances"):
        imp = model.importances()
    else:
        imp = model.stages[-1].featureImportances.toArray().tolist() if hasattr(model.stages[-1], "featureImportances") else None
    if imp is None:
        return spark.createDataFrame([], "feature string, importance double")
    rows = [(f, float(v)) for f, v in zip(run.features, imp)]
    out = spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
    return out if k is None else out.limit(k)
