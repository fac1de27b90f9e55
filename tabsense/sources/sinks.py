"""Table and report sinks (A4-A9) and the sample-table generator (A2).

Every sink is a distributed Spark writer: part files are written in
parallel and never funnelled through the driver.  JSON is written as JSON
lines (one array would not be splittable) with NULL fields kept; HTML is a
header part, one ``<tr>`` line per row, and a footer part, whose part files
concatenate in name order into one table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.functions.columns import q

# Format registry (name -> file extension, MIME type).
FORMATS = {
    "csv": (".csv", "text/csv"),
    "json": (".json", "application/json"),
    "parquet": (".parquet", "application/octet-stream"),
    "html": (".html", "text/html"),
}
TIMESTAMP_TEXT = "yyyy-MM-dd HH:mm:ss"


def html_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def _cell_text(df: DataFrame, name: str) -> Column:
    dt = df.schema[name].dataType
    c = q(name)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        c = F.date_format(c, TIMESTAMP_TEXT)
    return F.coalesce(html_escape(c.cast("string")), F.lit(""))


def html_rows(df: DataFrame) -> DataFrame:
    """One ``<tr><td>..</td></tr>`` line per row (missing cells empty)."""
    cells = [F.concat(F.lit("<td>"), _cell_text(df, c), F.lit("</td>")) for c in df.columns]
    return df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("line"))


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Write ``df`` under ``path`` in one of :data:`FORMATS`."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {sorted(FORMATS)}")
    if fmt == "csv":
        df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"') \
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False) \
            .option("timestampNTZFormat", TIMESTAMP_TEXT) \
            .option("timestampFormat", TIMESTAMP_TEXT).csv(path)
    elif fmt == "json":
        df.write.mode(mode).option("ignoreNullFields", False) \
            .option("timestampNTZFormat", TIMESTAMP_TEXT).json(path)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        spark = df.sparkSession
        head = "<table><thead><tr>" + "".join(
            f"<th>{c.replace('&', '&amp;').replace('<', '&lt;').replace('>', '&gt;')}</th>" for c in df.columns) \
            + "</tr></thead><tbody>"
        header = spark.createDataFrame([(head,)], "line string").coalesce(1)
        footer = spark.createDataFrame([("</tbody></table>",)], "line string").coalesce(1)
        header.unionAll(html_rows(df)).unionAll(footer).write.mode(mode).text(path)


def write_report(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A report frame (line_no, line) as one text file in line order.
    Reports hold a few dozen lines, so a single part file is right here."""
    lines.orderBy("line_no").select("line").coalesce(1).write.mode(mode).text(path)


# Fixed values of the generated sample table.
SAMPLE_CATEGORIES = ["Electronics", "Clothing", "Books", "Home", "Sports"]
SAMPLE_REGIONS = ["North", "South", "East", "West"]


def sample_orders(spark: SparkSession, n: int = 50, seed: int = 42) -> DataFrame:
    """A2: a generated order table (ids from 1001, daily dates from
    2024-01-01, random category, quantity 1-9, price 10-500 with 2 dp,
    region, total = round(quantity * price, 2)).  Same shape as the
    reference's sample; the random values are Spark's, not NumPy's."""
    cats = F.array(*[F.lit(c) for c in SAMPLE_CATEGORIES])
    regs = F.array(*[F.lit(r) for r in SAMPLE_REGIONS])
    base = spark.range(n).select(
        (F.col("id") + 1001).alias("order_id"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id AS INT))").alias("order_date"),
        F.concat(F.lit("Customer_"), (F.col("id") + 1).cast("string")).alias("customer_name"),
        F.element_at(cats, (F.floor(F.rand(seed) * len(SAMPLE_CATEGORIES)) + 1).cast("int")).alias("product_category"),
        (F.floor(F.rand(seed + 1) * 9) + 1).cast("bigint").alias("quantity"),
        F.round(F.rand(seed + 2) * 490 + 10, 2).alias("price"),
        F.element_at(regs, (F.floor(F.rand(seed + 3) * len(SAMPLE_REGIONS)) + 1).cast("int")).alias("region"),
    )
    return base.withColumn("total_amount", F.round(F.col("quantity") * F.col("price"), 2))
