"""Codes 0..k-1 of text values in sorted order, without a label list on the driver.

The distinct values are range-partitioned on (column, value); a value's code
is its place in its range plus the sizes of the ranges before it.  Codes are
joined back by a 128-bit hash of the value, so no text moves with the rows.
A dictionary of at most BROADCAST_LABELS labels is broadcast.  Of a larger
one, the labels that hold at least one of HOT_SHARE known cells (HOT_SHARE
labels at most) are broadcast, and the other cells are joined by a shuffle in
which no label is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsense.functions.columns import q
from tabsense.functions.frequencies import value_hashes
from tabsense.functions.ordered_fill import order_buckets
from tabsense.session import materialize

#: Labels (of 24 bytes) of a column that are broadcast, and the share of a column's cells, 1 / HOT_SHARE, from which a label of a larger one is.
BROADCAST_LABELS, HOT_SHARE = 100_000, 1_000


def label_dictionary(df: DataFrame, cols: list[str], buckets: int | None = None) -> DataFrame:
    """(position, value, code bigint, count) of every distinct non-null value of the text columns, codes by value ascending."""
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("position"), q(c).alias("value")) for i, c in enumerate(cols)])))
    counted = cells.where(F.col("value").isNotNull()).groupBy("position", "value").agg(F.count(F.lit(1)).alias("count"))
    ranges = order_buckets(counted, ["position", "value"], buckets)
    sizes = ranges.groupBy("_b", "position").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range and column: those of a column in range order
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("position").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_b", "position", before.alias("_start")))
    place = F.row_number().over(Window.partitionBy("_b", "position").orderBy("value"))
    return ranges.join(starts, ["_b", "position"]).select("position", "value", (F.col("_start") + place - 1).alias("code"), "count")


def encode(df: DataFrame, cols: list[str], names: list[str] | None = None, buckets: int | None = None) -> tuple[DataFrame, list[int]]:
    """``df`` with each text column's code (bigint, NULL for a NULL) in a column of ``names`` (the text columns themselves, if
    not given), and the number of labels of each column.  Other columns stay."""
    names = names or cols
    codes = materialize(label_dictionary(df, cols, buckets).select("position", *value_hashes(F.col("value")), "code", "count"))
    facts = {r["position"]: (r["labels"], r["cells"]) for r in
             codes.groupBy("position").agg(F.count(F.lit(1)).alias("labels"), F.sum("count").alias("cells")).collect()}  # one row per column
    for i, (c, name) in enumerate(zip(cols, names)):
        labels, cells = facts.get(i, (0, 0))
        df = _with_code(df, q(c), name, codes.where(F.col("position") == i), labels, cells)
    return df, [facts.get(i, (0, 0))[0] for i in range(len(cols))]


def _with_code(df: DataFrame, value: Column, name: str, codes: DataFrame, labels: int, cells: int) -> DataFrame:
    def table(rows: DataFrame, code: str) -> DataFrame:
        return rows.select(F.col("h1").alias("_label1"), F.col("h2").alias("_label2"), F.col("code").alias(code))
    keyed = df.select("*", *(h.alias(f"_label{n}") for n, h in enumerate(value_hashes(value), 1)))
    hot = codes if labels <= BROADCAST_LABELS else codes.where(F.col("count") * HOT_SHARE >= cells)
    out = keyed.join(F.broadcast(table(hot, "_code")), ["_label1", "_label2"], "left")
    if labels > BROADCAST_LABELS:
        out = materialize(out)  # both parts read it; cells with a code and NULLs are not shuffled
        done = F.col("_code").isNotNull() | F.col("_label1").isNull()
        cold = table(codes.where(F.col("count") * HOT_SHARE < cells), "_code")
        out = out.where(done).unionByName(out.where(~done).drop("_code").join(cold, ["_label1", "_label2"], "left"))
    columns = [F.col("_code").alias(name) if c == name else q(c) for c in df.columns]
    return out.select(*columns, *([] if name in df.columns else [F.col("_code").alias(name)]))
