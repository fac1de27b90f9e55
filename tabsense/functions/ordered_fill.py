"""Forward / backward fill along an explicit order without a global window.

``Window.orderBy(key)`` with no partition pulls every row into one task.
The two-level form used here:

1. rows are range-partitioned on the whole order key (any orderable types,
   NULLs first), with a hash of the row as the last key, so a value or a NULL
   that a third of the rows hold in the key is split as well; the partition
   index is the bucket.  The rows are checkpointed, so that both readers of
   the buckets see the same ones;
2. inside each bucket a partitioned window fills from earlier (later) rows:
   always the last known value up to the current row, along the ascending or
   the descending order, which Spark computes in one pass;
3. each bucket's last (first) non-null value is a tiny per-bucket aggregate;
   a window over the bucket table (one row per bucket, bounded) carries it
   across buckets, and it is broadcast back (size = buckets rows);
4. ``coalesce(inside, carried)``.

Rows that tie on the whole order key are filled in the order of their hash.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.functions.columns import q
from tabsense.session import materialize

#: Rows of one bucket: the number of buckets follows the rows, with one per shuffle partition at least.
ROWS_PER_BUCKET = 2_000_000


def _bucket_count(df: DataFrame, buckets: int | None) -> int:
    if buckets is not None:
        return buckets
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(math.ceil(df.count() / ROWS_PER_BUCKET), parts)


def order_buckets(df: DataFrame, order_by: list[str], buckets: int | None = None) -> DataFrame:
    """``df`` with ``_tie`` (a hash of the row) and ``_b``, the index of its contiguous range of the full order."""
    hashable = [q(f.name) for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    keyed = df.withColumn("_tie", F.xxhash64(*hashable))
    keys = [q(c).asc_nulls_first() for c in order_by] + [F.col("_tie").asc()]
    return materialize(keyed.repartitionByRange(_bucket_count(df, buckets), *keys).withColumn("_b", F.spark_partition_id()))


def ordered_fill(df: DataFrame, cols: list[str], order_by: list[str], direction: str = "forward",
                 buckets: int | None = None) -> DataFrame:
    """Fill NULLs of ``cols`` from the nearest earlier (``forward``) or later
    (``backward``) non-null value in ``order_by`` order.  Leading (trailing)
    gaps stay NULL, as in pandas ``ffill`` (``bfill``)."""
    if not cols:
        return df
    if direction not in ("forward", "backward"):
        raise ValueError("direction must be 'forward' or 'backward'")
    orig = df.columns
    b = order_buckets(df, order_by, buckets)
    fwd = direction == "forward"
    okeys = [q(c).asc_nulls_first() if fwd else q(c).desc_nulls_last() for c in order_by] + [
        F.col("_tie").asc() if fwd else F.col("_tie").desc()]
    # 2. inside each bucket
    w_in = Window.partitionBy("_b").orderBy(*okeys).rowsBetween(Window.unboundedPreceding, 0)
    # 3. per-bucket boundary value (ordering by a struct of the order keys)
    okey_struct = F.struct(*[q(c) for c in order_by], F.col("_tie"))
    pick = F.max_by if fwd else F.min_by
    per_bucket = b.groupBy("_b").agg(*[pick(q(c), F.when(q(c).isNotNull(), okey_struct)).alias(f"_e{i}")
                                       for i, c in enumerate(cols)])
    w_b = Window.orderBy(F.col("_b").asc() if fwd else F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_bucket.select("_b", *[F.last(f"_e{i}", ignorenulls=True).over(w_b).alias(f"_c{i}") for i in range(len(cols))])
    joined = b.join(F.broadcast(carry), "_b", "left")
    filled = []
    for i, c in enumerate(cols):
        inside = F.last(q(c), ignorenulls=True).over(w_in)
        filled.append(F.coalesce(inside, F.col(f"_c{i}")).cast(df.schema[c].dataType).alias(c))
    fill_set = set(cols)
    return joined.select(*[filled[cols.index(c)] if c in fill_set else q(c) for c in orig])
