"""Typed CSV scan (A1) with pandas-like missing-value tokens and types.

Spark's ``inferSchema`` differs from the reference's reader in ways that
change results: ``NA``/``null`` stay text (and turn a numeric column into
text), dates become dates, ``1d`` parses as a number.  This scan reads every
column as text, maps the documented missing tokens to NULL, and chooses each
column's type from one aggregation: bigint, else double, else boolean (only
``true``/``false`` with no missing cell), else string.  A column with no
value at all becomes double.  Dates are never inferred (they stay text, as
in the reference).  An explicit schema skips all of this.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.functions.columns import normalize_nan, q
from tabsense.operators.cleaning import dedupe_names
from tabsense.sources.csv_records import records

# Text read as a missing cell (pandas' default NA tokens).
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _cells(spark: SparkSession, path: str, sep: str, multiline: bool) -> tuple[list[str], DataFrame]:
    """(header, the rows' cells as text columns ``_c0`` ...), cells as pandas reads them: doubled quotes, line feeds inside
    quotes, white space kept."""
    if multiline:
        rows = records(spark, path, sep)
        first = rows.where("header").orderBy("file").select("cells").first()
        header = list(first["cells"]) if first is not None else []
        return header, rows.where(~F.col("header")).select(*[F.get("cells", F.lit(i)).alias(f"_c{i}") for i in range(len(header))])
    reader = lambda header: (spark.read.option("sep", sep).option("quote", '"').option("escape", '"').option("header", header)
                             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    first = reader(False).csv(path).first()
    raw = reader(True).csv(path)
    return [c if c is not None else "" for c in first or []], raw.toDF(*[f"_c{i}" for i in range(len(raw.columns))])


def infer_types(df: DataFrame) -> dict[str, T.DataType]:
    """Column -> Spark type from one pass over the text columns: the cells
    are unpivoted to (position, text) and the parse counts are grouped by
    column position (a small buffer per column at any width)."""
    cols = df.columns
    if not cols:
        return {}
    x = F.col("x")
    low = F.lower(F.trim(x))
    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("position"), q(c).cast("string").alias("x"))
                                        for i, c in enumerate(cols)])))
    rows = long.groupBy("position").agg(
        F.count(x).alias("n"),
        F.count(F.expr("try_cast(x AS BIGINT)")).alias("l"),
        F.count(F.when(~x.rlike("[dDfF]\\s*$") | low.isin("inf", "-inf", "+inf"),
                       F.expr("try_cast(x AS DOUBLE)"))).alias("d"),
        F.count(F.when(low.isin("true", "false"), 1)).alias("b"),
        F.count(F.lit(1)).alias("rows")).collect()
    got = {r["position"]: r for r in rows}
    out = {}
    for i, c in enumerate(cols):
        r = got.get(i)
        n = r["n"] if r else 0
        if n == 0:
            out[c] = T.DoubleType()      # no value at all: float column, as pandas
        elif r["l"] == n:
            out[c] = T.LongType()
        elif r["d"] == n:
            out[c] = T.DoubleType()
        elif r["b"] == n and n == r["rows"]:
            out[c] = T.BooleanType()
        else:
            out[c] = T.StringType()
    return out


def _typed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    if len(raw.columns) != len(schema.fields):
        raise ValueError(f"the files have {len(raw.columns)} columns, the schema {len(schema.fields)}")
    out = []
    for c, field in zip(raw.columns, schema.fields):
        cell = F.nullif(q(c), F.lit(""))
        value = cell.try_cast(field.dataType)
        bad = F.raise_error(F.concat(F.lit(f"not a {field.dataType.simpleString()} in column {field.name}: "), cell))
        out.append(F.when(cell.isNotNull() & value.isNull(), bad.cast(field.dataType)).otherwise(value).alias(field.name))
    return raw.select(*out)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             na_tokens: tuple[str, ...] = NA_TOKENS, sep: str = ",", multiline: bool = True) -> DataFrame:
    """A1: read CSV files with a header row into a typed DataFrame.

    ``multiline``: cells may hold line feeds inside quotes, as pandas reads them; a file is still read by as many tasks as
    it has ranges of ``spark.sql.files.maxPartitionBytes`` (:mod:`tabsense.sources.csv_records`), and its records are
    written to the shared folder once, from which types and rows come.  Set it to False for files known to hold no such
    cell, which are then only read.  A row with fewer cells than the header is filled with missing ones, further cells are
    left out.  With ``schema`` an empty cell is NULL, and a cell that does not parse raises an error."""
    header, raw = _cells(spark, path, sep, multiline)
    if schema is not None:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return normalize_nan(_typed(raw, wanted))
    names = dedupe_names(header) if len(header) == len(raw.columns) else raw.columns
    tokens = list(na_tokens)
    text = raw.select(*[F.when(q(c).isin(tokens), F.lit(None).cast("string")).otherwise(q(c)).alias(n)
                        for c, n in zip(raw.columns, names)])
    types = infer_types(text)
    cols = []
    for c in text.columns:
        t = types[c]
        if isinstance(t, T.StringType):
            cols.append(q(c))
        elif isinstance(t, T.BooleanType):
            cols.append((F.lower(F.trim(q(c))) == "true").alias(c))
        else:
            name = "BIGINT" if isinstance(t, T.LongType) else "DOUBLE"
            cols.append(F.expr(f"try_cast(`{c.replace('`', '``')}` AS {name})").alias(c))
    return normalize_nan(text.select(*cols))
