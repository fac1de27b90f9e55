"""Exact k nearest binary codes by incremental multi-index hashing.

A code has one bit per vector component.  It is cut into segments of about
log2(rows) bits, so that a segment's value holds about one code at any size of
the table, and each segment is indexed.  Round r looks up, in every segment,
the values that differ from the query's in exactly r bits, and keeps the
candidates nearer than the query's kth verified one.  Once all segments are
searched to radius r, a code not met differs in more than r bits in each
segment, so by at least segments * (r + 1) in all: a query is done when its kth
verified distance is below that.  A candidate is verified once, in the first
segment with its smallest segment distance.

Equal codes are one entry that holds its k + 1 smallest ids, and equal query
codes are searched once, so a very common vector costs no more than another.

Defined results: rows whose id or vector is NULL, empty, zero, or holds a
NULL or non-finite component take no part; repeated (id, vector) rows count
once; ties go to the smaller id; fewer than k candidates give fewer rows.  The
components that a shorter vector lacks count as not positive.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsense.llm.common import written

K = 10
#: Bits of a segment: log2 of the rows within these.
LEAST_WIDTH, MOST_WIDTH = 8, 24


def codes(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and the code, as an array of segments, of the signs of all components."""
    v = F.col(vector)
    good = (F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0))
    rows = vectors.where(good).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x > 0).alias("v"))
    size = rows.agg(F.max(F.size("v")).alias("bits"), F.count("*").alias("n")).first()
    bits = size["bits"] or 1
    width = min(max((size["n"] - 1).bit_length(), LEAST_WIDTH), MOST_WIDTH)
    segments = -(-bits // width)
    width = -(-bits // segments)

    def segment(s):
        part = F.slice("v", s * width + 1, width)
        return F.aggregate(F.transform(part, lambda x, i: F.when(x, F.call_function("shiftleft", F.lit(1), i)).otherwise(F.lit(0))), F.lit(0), lambda a, b: a.bitwiseOR(b))

    code = F.array(*[segment(s) for s in range(segments)])
    return rows.select("id", code.alias("code")).distinct()


def _apart(a, b, segments: int):
    """Bits that differ."""
    each = [F.bit_count(F.get(a, F.lit(s)).bitwiseXOR(F.get(b, F.lit(s)))) for s in range(segments)]
    return reduce(lambda x, y: x + y, each)


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """For each (id, code) of ``queries`` the k nearest other rows of ``vectors`` (id, code): query_id, rank, vec_id, distance."""
    shape = vectors.agg(F.max(F.size("code")).alias("segments"), F.max(F.array_max("code")).alias("top")).first()
    segments, width = shape["segments"] or 1, max((shape["top"] or 1).bit_length(), 1)
    farthest = segments * width + 1
    by_id = Window.partitionBy("code").orderBy("id")
    entries = written(vectors.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1)
                      .groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    index = written(entries.select("code", F.posexplode("code").alias("seg", "val"), F.col("ids")[0].alias("least"))
                    .select("code", "least", "seg", "val"), "segments")
    queries = written(queries, "queries")
    distinct = queries.select(F.col("code").alias("q")).distinct()
    active, found = distinct.withColumn("worst", F.lit(farthest)), None
    for radius in range(width + 1):
        masks = [sum(1 << b for b in bits) for bits in combinations(range(width), radius)]
        probes = active.select("q", "worst", F.posexplode("q").alias("seg", "own"))
        # a few queries make many probes: spread them first, over a number of tasks that stays as it is
        parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        probes = (probes.repartition(parts, "q", "seg").withColumn("mask", F.explode(_constant(masks)))
                  .select("q", "worst", "seg", F.col("own").bitwiseXOR(F.col("mask")).alias("val")))
        q, c = F.col("q"), F.col("code")
        distances = F.transform(F.arrays_zip(q.alias("a"), c.alias("b")), lambda x: F.bit_count(x["a"].bitwiseXOR(x["b"])))
        # once, in the first segment with the smallest distance, which is the radius
        first = (F.array_min(distances) == radius) & (F.array_position(distances, F.lit(radius)) == F.col("p.seg") + 1)
        # the optimizer sees the queries, not the many values each explodes to: never broadcast them
        p, x = probes.alias("p"), index.hint("shuffle_hash").alias("x")
        pairs = (p.join(x, (F.col("p.seg") == F.col("x.seg")) & (F.col("p.val") == F.col("x.val")) & (_apart(q, c, segments) <= F.col("worst")) & first)
                 .select("q", "code", "least", _apart(q, c, segments).alias("distance")))
        pairs = pairs if found is None else found.unionByName(pairs)
        nearest = Window.partitionBy("q").orderBy("distance", "least")
        found = written(pairs.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 1).drop("n"), "nearest")
        # k + 1 codes: a query's own row may be all there is to the first of them
        worst = found.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("w")).where(F.col("n") > k)
        active = written(distinct.join(worst, "q", "left")
                         .select("q", F.coalesce("w", F.lit(farthest)).alias("worst")).where(F.col("worst") >= segments * (radius + 1)), "active")
        if active.isEmpty():
            break
    ids = queries.select(F.col("id").alias("query_id"), F.col("code").alias("q"))
    rows = (ids.join(found.join(entries, "code"), "q").select("query_id", "distance", F.explode("ids").alias("vec_id"))
            .where(F.col("query_id") != F.col("vec_id")))
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return (rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", F.col("distance").cast("int").alias("distance")))


def _constant(values: list[int]):
    """An array of constants as one literal, however many there are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")
