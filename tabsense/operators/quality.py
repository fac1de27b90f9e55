"""Table-level quality measures: duplicates (C1), overview (B2), basic
profile (H1), missing-value report (H4), scorecard (G1), profile score (G2),
rule labels (G3) and the documented weighted score (N1).

Every measure is a small DataFrame produced by one or two aggregations over
the whole table; nothing but those aggregates reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.functions.columns import nan_as_missing, is_floating, name_of, numeric_columns, q

def row_hashes(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes equal for rows that group together: -0.0 reads as 0.0, a map as its JSON text, and a
    NULL (which Spark's hash skips) as a flag of its own."""
    cells = []
    for f in df.schema.fields:
        c = q(f.name)
        if is_floating(f.dataType):
            c = F.when(c == 0, F.lit(0.0).cast(f.dataType)).otherwise(c)
        elif isinstance(f.dataType, T.MapType):
            c = F.to_json(c)
        cells += [c.isNull(), c]
    return [F.xxhash64(F.lit(seed), *cells).alias(f"_h{seed}") for seed in (1, 2)]


def _distinct_rows(df: DataFrame) -> DataFrame:
    """Per distinct row, known by its 128-bit hash: ``_n`` rows and their ``_m`` missing cells.  One scan and one
    shuffle of 32-byte records at any width; a row that fills a third of the table is summed on the map side."""
    return (df.select(*row_hashes(df), _row_nulls(df).alias("_z")).groupBy("_h1", "_h2")
            .agg(F.count(F.lit(1)).alias("_n"), F.sum("_z").alias("_m")))


@nan_as_missing
def duplicate_rows_frame(df: DataFrame) -> DataFrame:
    """One row ``duplicate_rows``: rows repeating an earlier row on all columns."""
    return _distinct_rows(df).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


@nan_as_missing
def duplicate_count(df: DataFrame) -> DataFrame:
    """C1 as a one-row DataFrame (duplicate_rows)."""
    return duplicate_rows_frame(df)


def _row_nulls(df: DataFrame) -> Column:
    """Missing cells of one row."""
    return sum((q(c).isNull().cast("long") for c in df.columns[1:]), q(df.columns[0]).isNull().cast("long"))


def _missing_cells(df: DataFrame) -> Column:
    """Missing cells of the whole table: one sum of a per-row null count (a
    single aggregation buffer, whatever the number of columns)."""
    if not df.columns:
        return F.lit(0).cast("bigint")
    return F.coalesce(F.sum(_row_nulls(df)), F.lit(0)).cast("bigint")


@nan_as_missing
def table_counts(df: DataFrame) -> DataFrame:
    """One row: total_rows, missing_cells, duplicate_rows, from one scan."""
    zero = F.lit(0).cast("bigint")
    if not df.columns:
        return df.agg(F.count(F.lit(1)).alias("total_rows"), zero.alias("missing_cells"), zero.alias("duplicate_rows"))
    return _distinct_rows(df).agg(
        F.coalesce(F.sum("_n"), zero).cast("bigint").alias("total_rows"),
        F.coalesce(F.sum("_m"), zero).cast("bigint").alias("missing_cells"),
        F.coalesce(F.sum(F.col("_n") - 1), zero).cast("bigint").alias("duplicate_rows"))


@nan_as_missing
def quality_scorecard(df: DataFrame) -> DataFrame:
    """G1: completeness, duplicate rate and score (completeness - duplicate
    rate), all rounded half-even to 1 dp, plus the raw counts."""
    ncols = len(df.columns)
    t = table_counts(df)
    rows = F.col("total_rows")
    cells = rows * F.lit(ncols)
    completeness = F.when(cells > 0, (1 - F.col("missing_cells") / cells) * 100).otherwise(F.lit(0.0))
    dup_rate = F.when(rows > 0, F.col("duplicate_rows") / rows * 100).otherwise(F.lit(0.0))
    return t.select(
        F.bround(completeness - dup_rate, 1).alias("score"),
        F.bround(completeness, 1).alias("completeness"),
        F.bround(dup_rate, 1).alias("duplicate_rate"),
        F.col("duplicate_rows"),
        F.col("missing_cells"),
        rows.alias("total_rows"),
        F.lit(ncols).cast("bigint").alias("total_cols"),
    )


@nan_as_missing
def overview(df: DataFrame) -> DataFrame:
    """B2: rows, columns, numeric columns, missing cells and % of all cells,
    duplicate rows and % of rows (percentages to 1 dp)."""
    ncols = len(df.columns)
    nnum = len(numeric_columns(df))
    t = table_counts(df)
    rows = F.col("total_rows")
    cells = rows * F.lit(ncols)
    return t.select(
        rows.alias("rows"),
        F.lit(ncols).cast("bigint").alias("columns"),
        F.lit(nnum).cast("bigint").alias("numeric_columns"),
        F.col("missing_cells"),
        F.bround(F.when(cells > 0, F.col("missing_cells") / cells * 100).otherwise(0.0), 1).alias("missing_pct"),
        F.col("duplicate_rows"),
        F.bround(F.when(rows > 0, F.col("duplicate_rows") / rows * 100).otherwise(0.0), 1).alias("duplicate_pct"),
    )


@nan_as_missing
def profile_basic(df: DataFrame) -> DataFrame:
    """H1: total rows, columns, duplicate rows and duplicate % (2 dp)."""
    t = table_counts(df)
    rows = F.col("total_rows")
    return t.select(
        rows.alias("total_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        F.col("duplicate_rows"),
        F.bround(F.when(rows > 0, F.col("duplicate_rows") / rows * 100).otherwise(0.0), 2)
         .alias("duplicate_percentage"),
    )


@nan_as_missing
def null_counts_long(df: DataFrame) -> DataFrame:
    """(position, column_name, missing_count, total_rows) for every column,
    from one unpivot of the null flags grouped by column position."""
    cols = df.columns
    if not cols:
        return df.sparkSession.createDataFrame([], "position int, column_name string, missing_count bigint, total_rows bigint")
    flags = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), q(c).isNull().cast("long").alias("m"))
        for i, c in enumerate(cols)])))
    g = flags.groupBy("position").agg(F.sum("m").cast("bigint").alias("missing_count"),
                                      F.count(F.lit(1)).alias("total_rows"))
    # columns of an empty table have no group: list them all
    every = df.sparkSession.range(len(cols)).select(F.col("id").cast("int").alias("position"))
    zero = F.lit(0).cast("bigint")
    return (every.join(g, "position", "left")
            .select("position", name_of(F.col("position"), cols).alias("column_name"),
                    F.coalesce("missing_count", zero).alias("missing_count"), F.coalesce("total_rows", zero).alias("total_rows")))


@nan_as_missing
def missing_report(df: DataFrame) -> DataFrame:
    """H4 per column: columns with at least one missing cell, count and % of
    rows (2 dp).  Display order is % descending (``orderBy`` kept)."""
    long = null_counts_long(df)
    return (long.where(F.col("missing_count") > 0)
            .select("column_name", "missing_count",
                    F.bround(F.col("missing_count") / F.col("total_rows") * 100, 2).alias("missing_pct"))
            .orderBy(F.desc("missing_pct"), "column_name"))


@nan_as_missing
def missing_summary(df: DataFrame) -> DataFrame:
    """H4 totals: total missing cells, % of all cells (2 dp), columns with missing."""
    long = null_counts_long(df)
    ncols = len(df.columns)
    return long.agg(
        F.coalesce(F.sum("missing_count"), F.lit(0)).cast("bigint").alias("total_missing_cells"),
        F.bround(F.when(F.max("total_rows") * ncols > 0,
                        F.sum("missing_count") / (F.max("total_rows") * ncols) * 100).otherwise(0.0), 2)
         .alias("total_missing_pct"),
        F.count(F.when(F.col("missing_count") > 0, 1)).cast("bigint").alias("columns_with_missing"),
    )


# ---------------------------------------------------------------------------
# Rule labels (G3) -- fixed values that must equal the reference's wording.
# Score bands: >= 85 EXCELLENT, >= 70 GOOD, >= 50 FAIR, else POOR.
# Colour band of the score: >= 70 green, >= 50 amber, else red.
QUALITY_LEVEL_TEXT = {
    "EXCELLENT": "Data Quality: EXCELLENT - High quality dataset ready for analysis",
    "GOOD": "Data Quality: GOOD - Minor issues that were addressed",
    "FAIR": "Data Quality: FAIR - Some data quality concerns to note",
    "POOR": "Data Quality: POOR - Significant data quality issues",
}
NOTE_HIGH_DUPLICATES = "Note: High duplicate rate detected - may affect analysis"
NOTE_MISSING_HANDLED = "Note: Significant missing values were present and handled"
INSIGHT_MISSING = "Missing values detected - Consider investigating data collection processes"
INSIGHT_DUPLICATES = "High duplicate rate - Review data entry or merging processes"
INSIGHT_EXCELLENT = "Excellent data quality - Dataset is ready for advanced analysis"
INSIGHT_GOOD = "Good data quality - Minor issues addressed by cleaning"
INSIGHT_ATTENTION = "Data quality needs attention - Consider additional validation steps"
# ---------------------------------------------------------------------------


def quality_labels(scorecard: DataFrame) -> DataFrame:
    """Rule labels of a G1 scorecard (one output row per scorecard row)."""
    s, dup, miss, comp = F.col("score"), F.col("duplicate_rate"), F.col("missing_cells"), F.col("completeness")
    level = (F.when(s >= 85, "EXCELLENT").when(s >= 70, "GOOD").when(s >= 50, "FAIR").otherwise("POOR"))
    level_text = F.when(s >= 85, QUALITY_LEVEL_TEXT["EXCELLENT"]).when(s >= 70, QUALITY_LEVEL_TEXT["GOOD"]) \
        .when(s >= 50, QUALITY_LEVEL_TEXT["FAIR"]).otherwise(QUALITY_LEVEL_TEXT["POOR"])
    context_notes = F.concat_ws(" | ",
                                F.when(dup > 5, F.lit(NOTE_HIGH_DUPLICATES)),
                                F.when(miss > 100, F.lit(NOTE_MISSING_HANDLED)))
    insights = F.concat_ws(" | ",
                           F.when(comp < 90, F.lit(INSIGHT_MISSING)),
                           F.when(dup > 5, F.lit(INSIGHT_DUPLICATES)),
                           F.when(s >= 85, F.lit(INSIGHT_EXCELLENT)).when(s >= 70, F.lit(INSIGHT_GOOD))
                            .otherwise(F.lit(INSIGHT_ATTENTION)))
    color = F.when(s >= 70, "green").when(s >= 50, "amber").otherwise("red")
    return scorecard.select("score", level.alias("quality_level"), level_text.alias("quality_text"),
                            color.alias("color_band"), context_notes.alias("context_notes"),
                            insights.alias("report_insights"))
