"""Text summary (M1, dataset part) and profile comparison.

Lines are built from the small result DataFrames of the profile operators
(value counts, correlations, null counts); nothing row-level reaches the
driver.  Output is (line_no, line), ready for ``sources.sinks.write_report``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsense.functions.columns import nan_as_missing, categorical_columns, numeric_columns
from tabsense.functions.frequencies import top_k
from tabsense.functions.stats import fixed, null_count
from tabsense.operators.profile import correlation_pairs, describe_numeric, profile_numeric
from tabsense.operators.quality import null_counts_long

SUMMARY_CATEGORICAL = 5    # fixed values: columns and values listed, correlation pairs
SUMMARY_TOP_VALUES = 5
SUMMARY_PAIRS = 5


@nan_as_missing
def summary_lines(df: DataFrame) -> DataFrame:
    """M1 (dataset part): shape, column classes, missing cells, the top values
    of the first text columns and the strongest correlation pairs (3 dp)."""
    spark = df.sparkSession
    nums, cats = numeric_columns(df), categorical_columns(df)
    counts = df.agg(F.count(F.lit(1)).alias("rows"),
                    sum((null_count(c) for c in df.columns), F.lit(0)).alias("missing"))
    head = counts.select(F.explode(F.array(
        F.struct(F.lit(1).alias("line_no"), F.concat(F.lit("Dataset shape: "), F.col("rows").cast("string"),
                                                     F.lit(f" rows x {len(df.columns)} columns")).alias("line")),
        F.struct(F.lit(2).alias("line_no"),
                 F.lit("Numeric columns: " + (", ".join(nums) if nums else "None")).alias("line")),
        F.struct(F.lit(3).alias("line_no"),
                 F.lit("Categorical columns: " + (", ".join(cats) if cats else "None")).alias("line")),
        F.struct(F.lit(4).alias("line_no"), F.concat(F.lit("Missing values: "), F.col("missing").cast("string"),
                                                     F.lit(" total cells")).alias("line")))).alias("s")).select("s.*")
    parts = [head]
    shown = cats[:SUMMARY_CATEGORICAL]
    if shown:
        pos = {c: i for i, c in enumerate(shown)}
        tops = top_k(df, shown, SUMMARY_TOP_VALUES)
        items = F.sort_array(F.collect_list(F.struct("rank", F.concat(
            F.lit("'"), F.col("value"), F.lit("': "), F.col("count").cast("string")).alias("t"))))
        order = F.create_map(*[x for c, i in pos.items() for x in (F.lit(c), F.lit(i))])
        cat_lines = tops.groupBy("column_name").agg(items.alias("t")).select(
            (F.lit(100) + order[F.col("column_name")]).cast("int").alias("line_no"),
            F.concat(F.col("column_name"), F.lit(": {"),
                     F.array_join(F.transform("t", lambda s: s["t"]), ", "), F.lit("}")).alias("line"))
        parts.append(cat_lines)
    if len(nums) >= 2:
        pairs = correlation_pairs(df, nums, digits=3).where(F.col("correlation").isNotNull())
        top = pairs.orderBy(F.abs("correlation").desc(), "i", "j").limit(SUMMARY_PAIRS)
        w = Window.orderBy(F.abs("correlation").desc(), "i", "j")  # at most 5 rows
        parts.append(top.select((F.lit(200) + F.row_number().over(w)).cast("int").alias("line_no"),
                                F.concat(F.lit("  "), "variable_1", F.lit(" <-> "), "variable_2", F.lit(": "),
                                         F.col("correlation").cast("string")).alias("line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


COMPARED = ("mean", "median", "std", "min", "max", "q1", "q3", "skewness", "kurtosis")


def compare_profiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """The missing-value report (H4) and numeric profile (H2) of every
    column of two tables side by side (full outer join on the column name; one
    row per column, bounded) with the differences b - a.  Statistics of text
    and empty columns are NULL."""
    def prof(df, s):
        miss = null_counts_long(df).select(
            "column_name", (F.col("total_rows") - F.col("missing_count")).alias(f"count_{s}"),
            F.bround(F.when(F.col("total_rows") > 0, F.col("missing_count") / F.col("total_rows") * 100).otherwise(0.0), 2).alias(f"missing_pct_{s}"))
        stats = profile_numeric(df).select("column_name", *[F.col(c).alias(f"{c}_{s}") for c in COMPARED])
        return miss.join(stats, "column_name", "left")
    j = prof(a, "a").join(prof(b, "b"), "column_name", "full_outer")
    return j.select("column_name", F.col("count_a").isNotNull().alias("in_a"), F.col("count_b").isNotNull().alias("in_b"),
                    "count_a", "count_b", "missing_pct_a", "missing_pct_b",
                    F.bround(F.col("missing_pct_b") - F.col("missing_pct_a"), 2).alias("missing_pct_diff"),
                    *[f"{c}_{s}" for c in COMPARED for s in "ab"],
                    F.bround(F.col("mean_b") - F.col("mean_a"), 4).alias("mean_diff"))


# Summary headings and templates of the numeric, quality, cleaning and model blocks.
DESCRIBED = [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")]
SUMMARY_IMPORTANCES, SUMMARY_FEATURES, REPORT_IMPORTANCES = 5, 10, 10
CLASSIFICATION_LINES = [("accuracy", "Accuracy"), ("precision", "Precision"), ("recall", "Recall"), ("f1", "F1-Score")]
REGRESSION_LINES = [("r2", "R2 Score"), ("mae", "MAE"), ("mse", "MSE"), ("rmse", "RMSE")]


def describe_lines(df: DataFrame) -> DataFrame:
    """The ``describe`` block as (line_no, line), one line per numeric column, 3 dp."""
    nums = numeric_columns(df)
    head = df.sparkSession.createDataFrame([(0, "=== Numeric Summary ===")], "line_no int, line string")
    if not nums:
        return head.where("false")
    order = F.create_map(*[x for i, c in enumerate(nums) for x in (F.lit(c), F.lit(i + 1))])
    cells = [F.concat(F.lit(label + "="), F.when(F.col(c).isNull(), "NaN").otherwise(fixed(F.col(c), 3))) for c, label in DESCRIBED]
    return head.unionByName(describe_numeric(df, 3).select(
        order[F.col("column_name")].cast("int").alias("line_no"), F.concat(F.col("column_name"), F.lit(": "), F.concat_ws(", ", *cells)).alias("line")))


def _scalars(task: str) -> list[tuple[str, str]]:
    return (CLASSIFICATION_LINES if task == "classification" else REGRESSION_LINES) + [("cv_mean", "cv_mean"), ("cv_std", "cv_std")]


def _top_importances(importances: DataFrame, k: int) -> DataFrame:
    """The first ``k`` (rank, feature, importance); one row per feature, bounded."""
    w = Window.orderBy(F.desc("importance"), "feature")
    return importances.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def summary_blocks(scorecard: DataFrame | None = None, cleaning_summary: DataFrame | None = None, best: DataFrame | None = None,
                   target: str = "", task: str = "classification", features: list[str] = (), importances: DataFrame | None = None) -> DataFrame:
    """M1: the quality, cleaning and model blocks as (line_no, line), each
    where its one-row frame is given: a scorecard (G1), a cleaning summary
    (F2), the best model's metrics (J5) with its importances (J6)."""
    parts, text = [], lambda c: F.col(c).cast("string")

    def block(frame, start, items):
        rows = F.array(*[F.struct(F.lit(start + k).alias("line_no"), c.alias("line")) for k, c in enumerate(items)])
        parts.append(frame.select(F.explode(rows).alias("s")).select("s.*").where(F.col("line").isNotNull()))

    if scorecard is not None:
        block(scorecard, 300, [F.lit("=== Data Quality Assessment ==="), F.concat(F.lit("Overall Quality Score: "), text("score"), F.lit("/100")),
                               F.concat(F.lit("Completeness: "), text("completeness"), F.lit("%")),
                               F.concat(F.lit("Duplicate Rate: "), text("duplicate_rate"), F.lit("%")),
                               F.concat(F.lit("Missing Cells: "), text("missing_cells"))])
    if cleaning_summary is not None:
        block(cleaning_summary, 400, [F.lit("=== Data Cleaning Summary ==="), F.concat(F.lit("Rows before cleaning: "), text("rows_before")),
                                      F.concat(F.lit("Rows after cleaning: "), text("rows_after")),
                                      F.concat(F.lit("Rows removed: "), text("rows_removed")),
                                      F.when(F.col("steps") > 0, F.concat(F.lit("Cleaning operations: "), text("steps"), F.lit(" steps performed")))])
    if best is not None:
        more = len(features) - SUMMARY_FEATURES
        block(best, 500, [F.lit("=== Machine Learning Modeling Summary ==="), F.lit(f"Target Column: {target}"),
                          F.lit("Features Used: " + ", ".join(features[:SUMMARY_FEATURES])),
                          F.lit(f"  ... and {more} more features" if more > 0 else None).cast("string"),
                          F.lit("Task Type: " + task.capitalize()), F.concat(F.lit("Best Trained Model: "), F.col("model")),
                          F.lit("Model Performance Metrics on Test Set:"),
                          *[F.concat(F.lit(f"  {label}: "), fixed(F.col(c), 4)) for c, label in _scalars(task) if c != "cv_std"]])
        if importances is not None:
            top = _top_importances(importances, SUMMARY_IMPORTANCES)
            block(best, 550, [F.lit("Top Feature Importances (Predictive Power):")])
            parts.append(top.select((F.lit(550) + F.col("rank")).alias("line_no"),
                                    F.concat(F.lit("  "), "feature", F.lit(": "), fixed(F.col("importance"), 4)).alias("line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Wording of the modelling details and of the full context, and where a score's band begins.
DETAILS_TITLE = "=== MODELING RESULTS DETAILS ==="
ACCURACY_BANDS = [(0.9, "EXCELLENT - Model is highly accurate"), (0.8, "GOOD - Model performs well"), (0.7, "MODERATE - Model has reasonable accuracy")]
ACCURACY_LOW = "NEEDS IMPROVEMENT - Consider feature engineering or more data"
R2_BANDS = [(0.9, "EXCELLENT - Model explains 90%+ variance"), (0.7, "GOOD - Model explains 70%+ variance"), (0.5, "MODERATE - Model explains 50%+ variance")]
R2_LOW = "NEEDS IMPROVEMENT - Low explanatory power"
DETAILS_IMPORTANCES = 3
CONTEXT_COLUMNS, CONTEXT_CATEGORICAL, CONTEXT_VALUES = 15, 4, 3
# ---------------------------------------------------------------------------


def _numbered(frame: DataFrame, items: list) -> DataFrame:
    """(line_no, line) rows from (line_no, Column) items over a one-row frame; lines that are NULL are left out."""
    rows = F.array(*[F.struct(F.lit(k).alias("line_no"), c.cast("string").alias("line")) for k, c in items])
    return frame.select(F.explode(rows).alias("s")).select("s.*").where(F.col("line").isNotNull())


def model_details(best: DataFrame, target: str, task: str = "classification", importances: DataFrame | None = None) -> DataFrame:
    """M1: the modelling details as (line_no, line): the best model's (J5) score, its band, and its first three features."""
    L = F.lit
    if task == "classification":
        score, bands, low = F.col("accuracy"), ACCURACY_BANDS, ACCURACY_LOW
        scores = [F.concat(L("Best model accuracy: "), fixed(score, 4), L(" ("), fixed(score * 100, 1), L("%)")),
                  F.concat(L("Best model F1-Score: "), fixed(F.col("f1"), 4))]
    else:
        score, bands, low = F.col("r2"), R2_BANDS, R2_LOW
        scores = [F.concat(L("Best model R² score: "), fixed(score, 4)), F.concat(L("Best model RMSE: "), fixed(F.col("rmse"), 4))]
    band = L(low)
    for least, text in reversed(bands):
        band = F.when(score >= least, L(text)).otherwise(band)
    out = _numbered(best, [(600, L(DETAILS_TITLE)), (601, F.concat(L("Best performing model: "), F.col("model"))), (602, L(f"Task: {task} - predicting '{target}'")),
                           (603, scores[0]), (604, scores[1]), (605, F.concat(L("Performance: "), band))])
    if importances is None:
        return out
    top = _top_importances(importances, DETAILS_IMPORTANCES).agg(F.sort_array(F.collect_list(F.struct("rank", "feature"))).alias("t")).where(F.size("t") > 0)
    names = F.array_join(F.transform("t", lambda s: s["feature"]), ", ")
    return out.unionByName(_numbered(top, [(606, F.concat(L("Top 3 influential features: "), names))]))


@nan_as_missing
def full_context(df: DataFrame, scorecard: DataFrame | None = None, cleaning_summary: DataFrame | None = None, best: DataFrame | None = None,
                 target: str = "", task: str = "classification", columns: int = CONTEXT_COLUMNS, categorical: int = CONTEXT_CATEGORICAL,
                 values: int = CONTEXT_VALUES) -> DataFrame:
    """M1: the whole context as (line_no, line): shape, the first ``columns`` names, ``describe`` to 2 dp per numeric column, the
    first ``values`` values of the first ``categorical`` text columns, and the scorecard (G1), model (J5) and cleaning (F2) given."""
    L, text = F.lit, lambda c: F.col(c).cast("string")
    nums, cats, more = numeric_columns(df), categorical_columns(df), len(df.columns) - columns
    parts = [_numbered(df.agg(F.count(L(1)).alias("rows")), [
        (0, F.concat(L("Shape: "), text("rows"), L(f" rows × {len(df.columns)} columns"))), (1, L("Columns: " + ", ".join(df.columns[:columns]))),
        (2, L(f"... and {more} more columns" if more > 0 else None))])]
    one = df.sparkSession.range(1)
    if nums:
        order = F.create_map(*[x for i, c in enumerate(nums) for x in (L(c), L(i))])
        cells = [F.concat(L(label + "="), F.coalesce(fixed(F.col(c), 2), L("NaN"))) for c, label in DESCRIBED]
        parts += [_numbered(one, [(1000, L("Numeric Statistics:"))]), describe_numeric(df, 2).select(
            (L(1001) + order[F.col("column_name")]).alias("line_no"), F.concat(F.col("column_name"), L(": "), F.concat_ws(", ", *cells)).alias("line"))]
    shown = cats[:categorical]
    if shown:
        order = F.create_map(*[x for i, c in enumerate(shown) for x in (L(c), L(i))])
        pair = F.concat(L("'"), F.col("value"), L("': "), text("count"))
        tops = top_k(df, shown, values).groupBy("column_name").agg(F.sort_array(F.collect_list(F.struct("rank", pair.alias("t")))).alias("t"))
        names = df.sparkSession.createDataFrame([(c,) for c in shown], "column_name string")  # a column without values has a line too
        listed = F.concat(L("  "), F.col("column_name"), L(": {"), F.coalesce(F.array_join(F.transform("t", lambda s: s["t"]), ", "), L("")), L("}"))
        parts += [_numbered(one, [(2000, L("Categorical Columns:"))]),
                  names.join(tops, "column_name", "left").select((L(2001) + order[F.col("column_name")]).alias("line_no"), listed.alias("line"))]
    if scorecard is not None:
        parts.append(_numbered(scorecard, [(3000, F.concat(L("Data Quality Score: "), text("score"), L("/100"))),
                                           (3001, F.concat(L("Completeness: "), text("completeness"), L("%")))]))
    if best is not None:
        parts.append(_numbered(best, [
            (4000, F.concat(L("Machine Learning Model: "), F.col("model"))), (4001, L(f"Predicting Target: {target}")), (4002, L(f"Task type: {task}")),
            (4003, L("Model Performance Metrics:")), *[(4004 + k, F.concat(L(f"  {label}: "), fixed(F.col(c), 4))) for k, (c, label) in enumerate(_scalars(task))]]))
    if cleaning_summary is not None:
        parts.append(_numbered(cleaning_summary, [(5000, L("Cleaning Summary:")), (5001, F.concat(L("  - Rows before: "), text("rows_before"))),
                                                  (5002, F.concat(L("  - Rows after: "), text("rows_after"))), (5003, F.concat(L("  - Rows removed: "), text("rows_removed")))]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("line_no").cast("int").alias("line_no"), "line")


def model_section(best: DataFrame, target: str, task: str, importances: DataFrame | None = None, section: int = 4) -> DataFrame:
    """M2: the report's model section as (section, line_no, line): the best model's scalar metrics and its first ten importances."""
    L = F.lit
    rows = _lines(best, section, [
        (0, L(f"## {section}. Machine Learning Modeling")), (1, L("")), (2, L(f"**Target Variable:** `{target}`  ")),
        (3, L(f"**Task Type:** `{task.capitalize()}`  ")), (4, F.concat(L("**Best Algorithm:** `"), F.col("model"), L("`"))), (5, L("")),
        (6, L("| Metric | Value |")), (7, L("|--------|-------|")),
        *[(8 + k, F.concat(L(f"| {label} | "), fixed(F.col(c), 4), L(" |"))) for k, (c, label) in enumerate(_scalars(task))],
        (20, L(""))]).where(F.col("line").isNotNull())
    if importances is None:
        return rows
    head = _lines(best, section, [(21, L("### Feature Importances")), (22, L("")), (23, L("| Feature | Importance |")),
                                  (24, L("|---------|------------|")), (40, L(""))])
    top = _top_importances(importances, REPORT_IMPORTANCES).select(
        L(section).alias("section"), (L(section * 100 + 24) + F.col("rank")).alias("line_no"),
        F.concat(L("| "), "feature", L(" | "), fixed(F.col("importance"), 4), L(" |")).alias("line"))
    return rows.unionByName(head).unionByName(top)


# Markdown report wording (decoration dropped).
REPORT_TITLE = "# Data Analysis Report"
REPORT_FOOTER = "*Report generated by tabsense · {ts}*"


def _n(c):
    """Thousands-separated integer text."""
    return F.format_number(c.cast("bigint"), 0)


def _lines(frame: DataFrame, section: int, items: list) -> DataFrame:
    """(section, line_no, line) rows from (line_no, Column) items over a one-row frame."""
    return frame.select(F.explode(F.array(*[
        F.struct(F.lit(section).alias("section"), F.lit(section * 100 + k).alias("line_no"), c.alias("line"))
        for k, c in items])).alias("s")).select("s.*")


@nan_as_missing
def report_frame(df: DataFrame, file_name: str, generated_at: str, scorecard: DataFrame | None = None,
                 cleaning_summary: DataFrame | None = None, cleaning_log: DataFrame | None = None,
                 best: DataFrame | None = None, target: str = "", task: str = "classification",
                 importances: DataFrame | None = None) -> DataFrame:
    """M2: Markdown report as (section, line_no, line): header, dataset
    overview, quality assessment (if a scorecard is given), cleaning
    summary (if one is given) and model section (if the best model's metrics
    are given), numbered by what is present."""
    nums, cats = numeric_columns(df), categorical_columns(df)
    ncols = len(df.columns)
    base = df.agg(F.count(F.lit(1)).alias("rows"),
                  sum((null_count(c) for c in df.columns), F.lit(0)).alias("missing"))
    L = F.lit
    parts = [_lines(base, 0, [
        (0, L(REPORT_TITLE)), (1, L("")), (2, L(f"**File:** `{file_name}`  ")),
        (3, L(f"**Generated:** {generated_at}  ")),
        (4, F.concat(L("**Dataset Size:** "), _n(F.col("rows")), L(f" rows × {ncols} columns"))),
        (5, L("")), (6, L("---")), (7, L(""))]),
        _lines(base, 1, [
            (0, L("## 1. Dataset Overview")), (1, L("")), (2, L("| Metric | Value |")), (3, L("|--------|-------|")),
            (4, F.concat(L("| Total Rows | **"), _n(F.col("rows")), L("** |"))),
            (5, L(f"| Total Columns | **{ncols}** |")), (6, L(f"| Numeric Columns | **{len(nums)}** |")),
            (7, L(f"| Categorical Columns | **{len(cats)}** |")),
            (8, F.concat(L("| Missing Cells | **"), _n(F.col("missing")), L("** |"))), (9, L(""))])]
    section = 2
    if scorecard is not None:
        parts.append(_lines(scorecard, section, [
            (0, L(f"## {section}. Data Quality Assessment")), (1, L("")),
            (2, F.concat(L("### Overall Quality Score: **"), F.col("score").cast("string"), L("/100**"))),
            (3, L("")), (4, L("| Dimension | Score |")), (5, L("|-----------|-------|")),
            (6, F.concat(L("| Completeness | "), F.col("completeness").cast("string"), L("% |"))),
            (7, F.concat(L("| Duplicate Rate | "), F.col("duplicate_rate").cast("string"), L("% |"))), (8, L(""))]))
        section += 1
    if cleaning_summary is not None:
        parts.append(_lines(cleaning_summary, section, [
            (0, L(f"## {section}. Data Cleaning Summary")), (1, L("")),
            (2, F.concat(L("- **Rows before cleaning:** "), _n(F.col("rows_before")))),
            (3, F.concat(L("- **Rows after cleaning:** "), _n(F.col("rows_after")))),
            (4, F.concat(L("- **Rows removed:** "), _n(F.col("rows_removed")))), (5, L(""))]))
        if cleaning_log is not None:
            s = section
            head = _lines(cleaning_summary.where(F.col("steps") > 0), s,
                          [(6, L("### Cleaning Operations Performed:")), (7, L("")), (99, L(""))])
            body = cleaning_log.select(F.lit(s).alias("section"), (F.lit(s * 100 + 10) + F.col("step_no")).alias("line_no"),
                                       F.concat(L("- "), F.col("message")).alias("line"))
            parts += [head, body]
        section += 1
    if best is not None:
        parts.append(model_section(best, target, task, importances, section))
    parts.append(_lines(base, 9, [(0, L("---")), (1, L(REPORT_FOOTER.format(ts=generated_at)))]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("section").cast("int"), F.col("line_no").cast("int"), "line")
