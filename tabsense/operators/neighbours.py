"""Exact nearest neighbours inside a class, by a pivot index.

About the square root of a class's points are its pivots; a point belongs to the cell of its nearest pivot.  A point looks
into its own cell first.  What it finds there, or the pivots themselves, bounds the distance of its kth neighbour; by the
triangle inequality only cells that can hold a nearer point are visited after that.  Cells, and the points that visit one,
are split into blocks, so no task holds more than two blocks however large or often visited a cell is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.session import shared_scratch, worker_path

#: Points of one block; a class of at most so many is one cell.
BLOCK_POINTS = 4_096
#: Pivots of all classes, which every task gets (beyond some 4 * 10**9 points cells grow instead).
MAX_PIVOTS = 65_536
_CELLS_AT_ONCE = 1 << 17  # distances (1 MB: they stay in a core's cache)
_FOUND = "_k int, _pid long, near array<struct<d: double, x: array<double>, m: long>>"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``a`` to those of ``b``; features are summed in their order, so equal pairs tie."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        out += (a[:, i, None] - b[None, :, i]) ** 2
    return np.sqrt(out)


def _matrix(x: pd.Series, width: int) -> np.ndarray:
    return np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, width))


def _steps(rows: int, across: int) -> Iterator[slice]:
    step = max(1, _CELLS_AT_ONCE // max(across, 1))
    return (slice(i, i + step) for i in range(0, rows, step))


def _assign(frames: Iterator[pd.DataFrame], pivots, k: int) -> Iterator[pd.DataFrame]:
    """Cell, distance to its pivot, and distance of the kth pivot that is not the point itself."""
    for frame in frames:
        for c, rows in frame.groupby("_k"):
            p = pivots.value[c]
            x = _matrix(rows["x"], p.shape[1])
            for part in _steps(len(x), len(p)):
                d = distances(x[part], p)
                cell = d.argmin(1)
                own = d[np.arange(len(d)), cell]
                some = sorted({min(i, d.shape[1] - 1) for i in (k - 1, k)})
                d.partition(some, 1)
                kth = np.where(own == 0, k, k - 1)
                far = np.where(kth < d.shape[1], d[np.arange(len(d)), np.minimum(kth, d.shape[1] - 1)], np.inf)
                yield rows.iloc[part].assign(_cell=cell, _own=own, _far=far)


def _visits(frames: Iterator[pd.DataFrame], pivots, radii) -> Iterator[pd.DataFrame]:
    """The other cells that may hold a point within a point's bound: a point y of cell c is at least d(x, c) - radius(c), and,
    as y is no farther from c than from x's own pivot, (d(x, c) - d(x, own)) / 2 away."""
    for frame in frames:
        for c, rows in frame.groupby("_k"):
            p, r = pivots.value[c], radii.value[c]
            x, own, bound = _matrix(rows["x"], p.shape[1]), rows["_own"].to_numpy(), rows["_bound"].to_numpy()
            for part in _steps(len(x), len(p)):
                d = distances(x[part], p)
                least = np.maximum(d - r, (d - own[part, None]) / 2)
                # the margin covers the rounding of the distances
                near = (least <= bound[part, None] + 1e-9 * (d + own[part, None] + 1e-300)) & (r >= 0)
                near[np.arange(len(d)), rows["_cell"].to_numpy()[part]] = False
                i, cell = np.nonzero(near)
                yield rows.iloc[part].iloc[i][["_k", "_pid", "x"]].assign(_cell=cell)


def _rows(x: pa.ChunkedArray) -> np.ndarray:
    n = len(x)
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in x.chunks]) if n else np.zeros(0)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel(), pa.float64()))


def _block(k: int):
    def run(asking: pa.Table, held: pa.Table) -> pa.Table:
        n, x, rows, cols, dist = asking.num_rows, _rows(held["hx"]), [], [], []
        if n and len(x):
            order = np.lexsort(x.T[::-1])  # columns in the order of x, so that equal distances are in it too
            x, pid, m = x[order], held["h_pid"].to_numpy()[order], held["hm"].to_numpy()[order]
            a, asked = _rows(asking["x"]), asking["_pid"].to_numpy()
            last = min(k, len(x)) - 1
            for part in _steps(n, len(x)):
                d = distances(a[part], x)
                d[asked[part, None] == pid[None, :]] = np.inf
                limit = np.partition(d, last, axis=1)[:, last]
                i, j = np.nonzero((d <= limit[:, None]) & (d < np.inf))
                found = d[i, j]
                by = np.lexsort((j, found, i))
                i, j, found = i[by], j[by], found[by]
                first = np.arange(len(i)) - np.searchsorted(i, i) < k
                rows.append(i[first] + part.start), cols.append(j[first]), dist.append(found[first])
        row, col = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (rows, cols))
        near = pa.StructArray.from_arrays([pa.array(np.concatenate(dist) if dist else np.zeros(0), pa.float64()), _lists(x[col]),
                                           pa.array(m[col] if len(col) else [], pa.int64())], names=["d", "x", "m"])
        ends = np.append(0, np.cumsum(np.bincount(row, minlength=n)))
        return pa.table({"_k": asking["_k"].cast(pa.int32()), "_pid": asking["_pid"].cast(pa.int64()),
                         "near": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), near)})
    return run


def _search(asking: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """The k nearest of ``held`` in the cell that each row of ``asking`` names, by blocks of both sides."""
    cell = ["_k", "_cell"]
    blocks = lambda n: F.ceil(n / F.lit(BLOCK_POINTS)).cast("int")
    sizes = held.groupBy(cell).agg(blocks(F.count("*")).alias("_h")) \
        .join(asking.groupBy(cell).agg(blocks(F.count("*")).alias("_a")), cell)  # one row per cell
    dealt = lambda n, seed: F.pmod(F.xxhash64("_pid", F.lit(seed)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = asking.select(*cell, "_pid", "x").join(F.broadcast(sizes), cell) \
        .withColumn("_aa", dealt(F.col("_a"), 1)).withColumn("_hh", every(F.col("_h")))
    right = held.select(*cell, "_pid", "x", "m").join(F.broadcast(sizes), cell) \
        .withColumn("_hh", dealt(F.col("_h"), 2)).withColumn("_aa", every(F.col("_a")))
    keys = [*cell, "_aa", "_hh"]
    right = right.select(*[F.col(c).alias(f"h{c}") for c in (*keys, "_pid", "x", "m")])  # names of its own: both may be one table
    return left.select(*keys, "_pid", "x").groupBy(keys).cogroup(right.groupBy([f"h{c}" for c in keys])).applyInArrow(_block(k), _FOUND)


def _merged(found: DataFrame, k: int) -> DataFrame:
    return found.groupBy("_k", "_pid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def nearest(points: DataFrame, k: int) -> DataFrame:
    """(_k, _pid, near) for ``points`` (_k class, _pid, x, m), whose x differ inside a class and hold no NULL: the k nearest other
    points of the class (all, if fewer), nearest first, ties by x.  Only pivots and the radii of their cells reach the driver."""
    spark = points.sparkSession
    worker_path(spark)
    sizes = {r["_k"]: r["n"] for r in points.groupBy("_k").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], _FOUND)
    most = max(1, MAX_PIVOTS // len(sizes))
    wanted = {c: min(most, int(np.ceil(np.sqrt(n)))) if n > BLOCK_POINTS else 0 for c, n in sizes.items()}
    share = F.element_at(F.create_map(*[F.lit(v) for c, n in sizes.items() for v in (c, wanted[c] / n)]), F.col("_k"))
    draw = F.xxhash64("x", F.lit(7))
    picked = points.where(F.pmod(draw, F.lit(1 << 31)) < share * (1 << 31)).select("_k", "x") \
        .unionByName(points.groupBy("_k").agg(F.min_by("x", draw).alias("x"))).distinct()
    pivots = {c: _matrix(rows["x"], 0) for c, rows in picked.toPandas().groupby("_k")}
    shared = spark.sparkContext.broadcast(pivots)
    path = shared_scratch(spark, "neighbour-cells")
    schema = "_k int, _pid long, x array<double>, m long, _cell int, _own double, _far double"
    points.select("_k", "_pid", "x", "m").mapInPandas(lambda f: _assign(f, shared, k), schema).write.parquet(path)
    held = spark.read.schema(schema).parquet(path)
    first = _merged(_search(held, held, k), k)
    if all(len(p) == 1 for p in pivots.values()):
        return first
    path = shared_scratch(spark, "neighbour-first")
    first.write.parquet(path)
    first = spark.read.schema(_FOUND).parquet(path)
    radii = {c: np.full(len(p), -1.0) for c, p in pivots.items()}
    for r in held.groupBy("_k", "_cell").agg(F.max("_own").alias("r")).collect():
        radii[r["_k"]][r["_cell"]] = r["r"]
    spread = spark.sparkContext.broadcast(radii)
    kth = F.when(F.size("near") >= k, F.element_at("near", k)["d"]).otherwise(F.lit(float("inf")))
    asking = held.join(first.select("_k", "_pid", kth.alias("_kth")), ["_k", "_pid"]) \
        .select("_k", "_pid", "x", "_cell", "_own", F.least("_kth", "_far").alias("_bound"))
    path = shared_scratch(spark, "neighbour-visits")
    visit_schema = "_k int, _pid long, x array<double>, _cell int"
    asking.mapInPandas(lambda f: _visits(f, shared, spread), visit_schema).write.parquet(path)
    visits = spark.read.schema(visit_schema).parquet(path)
    return _merged(first.unionByName(_search(visits, held, k)), k)
