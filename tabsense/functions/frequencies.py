"""Value counts and most frequent values of many columns, long texts left in place.

The table is unpivoted to cells and grouped once; a value is known by a
128-bit hash and its first HEAD characters, so one shuffle of short records
(combined on the map side) serves frequencies, modes and distinct counts of
every column.  A value held by a third of all rows collapses to one partial
count per map task before the shuffle.  The texts of winners longer than HEAD
characters are fetched by a second scan that keeps nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsense.functions.columns import is_floating, name_of, q
from tabsense.session import materialize

#: Characters of a value that travel with its hash.  A longer value is fetched whole once it is known to matter.
HEAD = 32
#: Keys of 20 bytes that a second scan gets by broadcast; beyond it they are joined by a shuffle.
BROADCAST_KEYS = 100_000


def value_hashes(value: Column) -> list[Column]:
    """128 bits of a value as two longs; both NULL for a NULL."""
    return [F.when(value.isNotNull(), F.xxhash64(F.lit(seed), value)).alias(f"h{seed}") for seed in (1, 2)]


def _cells(df: DataFrame, cols: list[str], *extra) -> DataFrame:
    """One row per cell: position, h1, h2 and ``extra`` columns, functions of the value as text."""
    def cell(i, c):
        v = q(c).cast("string")
        return F.struct(F.lit(i).alias("position"), *value_hashes(v), *(f(v) for f in extra))
    return df.select(F.inline(F.array(*[cell(i, c) for i, c in enumerate(cols)])))


def _counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(position, h1, h2, head, long, count) of every distinct value; NULL cells are one value with NULL hashes."""
    head = lambda v: F.substring(v, 1, HEAD).alias("head")
    long = lambda v: (F.char_length(v) > HEAD).alias("long")
    return (_cells(df, cols, head, long).groupBy("position", "h1", "h2", "head", "long")
            .agg(F.count(F.lit(1)).alias("count")))


def frequent_values(df: DataFrame, cols: list[str], k: int) -> DataFrame:
    """The ``k`` most frequent values of each column by count desc, value asc: (column_name, rank, value, count), with the
    column's totals ``known`` and ``missing`` cells and ``n_unique`` values on each row.  A column without values has one row
    of NULL rank.

    Ties are settled by the whole value: all values that share count and head with one of the first ``k`` are candidates, and
    the long ones' texts are fetched before they are ranked.  A count of the candidates runs at once."""
    schema = ("column_name string, rank int, value string, count bigint, known bigint, missing bigint, n_unique bigint")
    if not cols:
        return df.sparkSession.createDataFrame([], schema)
    counts = _counts(df, cols)
    known = F.col("h1").isNotNull()
    zero = F.lit(0).cast("bigint")
    totals = counts.groupBy(F.col("position").alias("_p")).agg(
        F.coalesce(F.sum(F.when(known, F.col("count"))), zero).alias("known"),
        F.coalesce(F.sum(F.when(~known, F.col("count"))), zero).alias("missing"),
        F.count(F.when(known, 1)).alias("n_unique"))
    # row_number() <= k is planned with a partial WindowGroupLimit: a column's task sees k rows per map partition at most
    first = Window.partitionBy("position").orderBy(F.desc("count"), F.asc("head"))
    tops = (counts.where(known).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k)
            .select("position", "count", "head").distinct())  # k rows per column
    near = counts.where(known).join(F.broadcast(tops), ["position", "count", "head"])
    every = df.sparkSession.createDataFrame([(i,) for i in range(len(cols))], "_p int")
    found = materialize(every.join(totals, "_p", "left").na.fill(0, ["known", "missing", "n_unique"])
                        .join(near, F.col("_p") == F.col("position"), "left").drop("position"))
    wanted = found.where("long").select(F.col("_p").alias("position"), "h1", "h2")
    n_long = wanted.count()
    if n_long:
        keys = F.broadcast(wanted) if n_long <= BROADCAST_KEYS else wanted
        texts = (_cells(df, cols, lambda v: v.alias("text"), lambda v: (F.char_length(v) > HEAD).alias("_long")).where("_long")
                 .join(keys, ["position", "h1", "h2"]).groupBy(F.col("position").alias("_p"), "h1", "h2", "text").agg(F.lit(1).alias("_one")))
        found = found.join(texts.drop("_one"), ["_p", "h1", "h2"], "left").withColumn("value", F.coalesce("text", "head"))
    else:
        found = found.withColumn("value", F.col("head"))
    whole = Window.partitionBy("_p").orderBy(F.desc("count"), F.asc("value"))
    ranked = found.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)
    return ranked.select(name_of(F.col("_p"), cols).alias("column_name"), F.when(F.col("n_unique") > 0, F.col("rank")).alias("rank"),
                         "value", "count", "known", "missing", "n_unique")


def top_k(df: DataFrame, cols: list[str], k: int) -> DataFrame:
    """(column_name, rank, value, count): the ``k`` most frequent values of each column, ties by value."""
    return frequent_values(df, cols, k).where(F.col("rank").isNotNull()).select("column_name", "rank", "value", "count")


def hashed_distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, n_unique): exact distinct non-null values per column, from one shuffle of 128-bit value hashes
    (a text is never shuffled; -0.0 counts as 0.0)."""
    def cell(i, c):
        v = q(c)
        if is_floating(df.schema[c].dataType):
            v = F.when(v == 0, F.lit(0.0).cast(df.schema[c].dataType)).otherwise(v)
        return F.struct(F.lit(i).alias("position"), F.when(q(c).isNotNull(), F.xxhash64(F.lit(1), v)).alias("h1"),
                        F.xxhash64(F.lit(2), v).alias("h2"))
    long = df.select(F.inline(F.array(*[cell(i, c) for i, c in enumerate(cols)]))).where(F.col("h1").isNotNull())
    return (long.groupBy("position", "h1", "h2").agg(F.lit(1).alias("one")).groupBy("position").agg(F.count(F.lit(1)).alias("n_unique"))
            .select(name_of(F.col("position"), cols).alias("column_name"), "n_unique"))
