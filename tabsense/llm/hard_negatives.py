"""Hard negatives by an inverted multi-index over integer vectors.

Two codebooks, one for each half of the components, are fitted by k-means on a
bounded sample; a row belongs to the cell of its two nearest codewords.  A
codeword's radius is the greatest distance of a member's half from it, so

    anchor_half . codeword + |anchor_half| * radius

bounds the half score of all its members, and the sum of both halves' bounds
the score of all rows in a cell.  An anchor visits the cells in descending
order of that sum, merging the two sorted codebooks with a heap, until

* its positives are certain: there are as many as asked, and the least of them
  scores above the next cell's bound;
* then, for every window of scores that a positive sets, the window is
  certified: it has its k rows and the kth scores above the next cell's bound,
  or that bound is below the window.  Cells that lie above all windows are
  passed over.

The index holds every row: cells are range partitioned by codeword pair and a
hash, and cut into parts of a bounded number of rows, so that one very common
vector is spread too.  Anchors go in blocks of bounded bytes, which are
broadcast; cells stay where they are, and a round joins them with the visits
that its anchors' heaps ask for.  Each round visits more rows of an anchor than
the last; the last round takes all that is left uncertified.

Scores are inner products of whole numbers: in doubles while they are exact,
else in 64-bit integers.

Defined results: rows with a NULL id or label, a NULL or empty vector, or a
NULL or non-finite component take no part; equal (id, label, vector) rows are
one; rows that share an anchor's id are not its positives or negatives; vectors
of another length are not compared; an anchor without positives, or whose
windows hold no row, gives none; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsense.llm.common import written

SCALE = 256
POSITIVES, K = 5, 10
#: Score of a negative as hundredths of its positive's.
WINDOW = (30, 90)
#: Rows that the codebooks are fitted on; codewords of a half at most; rows of a cell wanted, and of one part of it at most.
SAMPLE_ROWS, MAX_CODEWORDS, CELL_ROWS, PART_ROWS = 8192, 256, 256, 1024
#: Bytes of a broadcast block of anchors; rows that an anchor visits in the first round, and how much more in each next one.
ANCHOR_BYTES, FIRST_ROWS, GROWTH = 8 << 20, 4096, 16
ROUNDS = 3
_EXACT = 2 ** 53
_BUFFER = 1 << 18
_FOUND = "anchor int, win int, score long, id long"


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """id, label (as text), vec: floor(256 * x) of every component of the rows that take part."""
    v = F.col(vector)
    good = (F.col(id_col).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0)
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return rows.where(good).select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("string").alias("label"),
                                   F.transform(v, lambda x: F.floor(x.cast("double") * SCALE)).alias("vec")).distinct()


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codeword nearest to each row, and the distance from it."""
    if not x.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x))
    code = np.argmin((centres * centres).sum(1) - 2 * (x @ centres.T), axis=1)
    return code, np.sqrt(((x - centres[code]) ** 2).sum(1))


def codebook(x: np.ndarray, n: int, seed: int = 7, steps: int = 10) -> np.ndarray:
    """At most ``n`` codewords by k-means, the same for the same rows."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.permutation(len(distinct))[:n]].astype(np.float64)
    for _ in range(steps):
        code, _ = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, code, x)
        size = np.bincount(code, minlength=len(centres))
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


def _assign_batches(batches, books, dim: int) -> Iterator[pa.RecordBatch]:
    half = dim // 2 + dim % 2
    for batch in batches:
        x = _matrix(batch.column(2), dim).astype(np.float64)
        (c1, d1), (c2, d2) = nearest(x[:, :half], books.value[0]), nearest(x[:, half:], books.value[1])
        yield pa.record_batch([*batch.columns, pa.array(c1, pa.int32()), pa.array(c2, pa.int32()), pa.array(d1), pa.array(d2)],
                              names=["id", "label", "vec", "c1", "c2", "d1", "d2"])


def _part_batches(batches, dim: int) -> Iterator[pa.RecordBatch]:
    """Parts of cells, from rows of which those of a cell stand together."""
    for batch in batches:
        if not batch.num_rows:
            continue
        c1, c2 = batch.column(3).to_numpy(), batch.column(4).to_numpy()
        runs = np.flatnonzero(np.append(True, (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])))
        cuts = np.array([c for a, b in zip(runs, np.append(runs[1:], len(c1))) for c in range(a, b, PART_ROWS)])
        ends = np.append(cuts, len(c1))
        lists = lambda values, per=1: pa.ListArray.from_arrays(pa.array(ends * per, pa.int32()), values)
        flat = batch.column(2).flatten()
        yield pa.record_batch([pa.array(c1[cuts]), pa.array(c2[cuts]), lists(batch.column(0)), lists(batch.column(1)), lists(flat, dim)],
                              names=["c1", "c2", "ids", "labels", "vecs"])


class Cells:
    """The codebooks, each codeword's radius, and the rows of each cell: at most MAX_CODEWORDS squared numbers."""

    def __init__(self, books, radii, rows: np.ndarray):
        self.books, self.radii, self.rows = books, radii, rows

    def bounds(self, anchor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half the least and the greatest half score that a member of each codeword can have."""
        half = self.books[0].shape[1]
        out = []
        for part, centres, radius in zip((anchor[:half], anchor[half:]), self.books, self.radii):
            middle, spread = centres @ part, np.sqrt((part * part).sum()) * radius
            slack = 1e-9 * (1 + np.abs(middle) + spread)  # of rounding
            out.append((middle - spread - slack, middle + spread + slack))
        return out

    def visit(self, anchor: np.ndarray):
        """(first codeword, second, least, greatest score) of the cells that hold rows, by descending greatest score."""
        (low1, high1), (low2, high2) = self.bounds(anchor)
        o1, o2 = np.argsort(-high1, kind="stable"), np.argsort(-high2, kind="stable")
        heap, taken = [(-(high1[o1[0]] + high2[o2[0]]), 0, 0)], [0] * len(o1)  # taken: cells of each row popped so far
        while heap:
            top, i, j = heapq.heappop(heap)
            taken[i] = j + 1
            if i + 1 < len(o1) and taken[i + 1] == j:
                heapq.heappush(heap, (-(high1[o1[i + 1]] + high2[o2[j]]), i + 1, j))
            if j + 1 < len(o2) and (i == 0 or taken[i - 1] > j + 1):
                heapq.heappush(heap, (-(high1[o1[i]] + high2[o2[j + 1]]), i, j + 1))
            a, b = int(o1[i]), int(o2[j])
            if self.rows[a, b]:
                yield a, b, low1[a] + low2[b], -top


def index(rows: DataFrame, dim: int) -> tuple[DataFrame, Cells]:
    """Parts of cells of ``rows`` (id, label, vec), and what the heaps need to know of the cells."""
    n = rows.count()
    codewords = min(max(round((n / CELL_ROWS) ** 0.5), 1), MAX_CODEWORDS)
    sample = rows.select("vec", F.xxhash64("id", "vec").alias("h")).orderBy("h").limit(SAMPLE_ROWS).select("vec").toPandas()
    x = np.stack([np.asarray(v, np.float64) for v in sample["vec"]])
    half = dim // 2 + dim % 2
    books = [codebook(part, codewords) for part in (x[:, :half], x[:, half:])]
    shared = rows.sparkSession.sparkContext.broadcast(books)
    assigned = written(rows.mapInArrow(lambda b: _assign_batches(b, shared, dim),
                                       "id long, label string, vec array<long>, c1 int, c2 int, d1 double, d2 double"), "assigned")
    radii = [np.zeros(len(b)) for b in books]
    for r, c, d in zip(radii, ("c1", "c2"), ("d1", "d2")):
        for row in assigned.groupBy(c).agg(F.max(d).alias("d")).collect():
            r[row[c]] = row["d"]
    held = np.zeros([len(b) for b in books], np.int64)
    for row in assigned.groupBy("c1", "c2").agg(F.count("*").alias("n")).collect():
        held[row["c1"], row["c2"]] = row["n"]
    spread = assigned.select("id", "label", "vec", "c1", "c2").repartitionByRange("c1", "c2", F.xxhash64("id")).sortWithinPartitions("c1", "c2")
    parts = spread.mapInArrow(lambda b: _part_batches(b, dim), "c1 int, c2 int, ids array<long>, labels array<string>, vecs array<long>")
    return written(parts, "cells"), Cells(books, radii, held)


class Anchors:
    """A block of anchors and what is known of each: the scores it still looks for, and how far its heap has come."""

    def __init__(self, ids: np.ndarray, labels: list[str], x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        self.seen = np.zeros(len(ids), np.int64)               # cells popped
        self.next = np.full(len(ids), np.inf)                  # bound of the next cell
        self.low, self.high = None, None                       # windows, anchors x POSITIVES
        self.least = np.full((len(ids), 1), -2 ** 63, np.int64)  # scores below are not looked for

    def windows(self, scores: np.ndarray, known: np.ndarray) -> None:
        low, high = WINDOW
        whole, rest = scores // 100, scores % 100  # 100 * score itself may not fit in 64 bits
        self.low, self.high = low * whole - (-low * rest // 100), high * whole + high * rest // 100
        self.low[~known], self.high[~known] = 1, 0
        self.least = self.low.copy()
        self.seen[:] = 0
        self.next[:] = np.inf

    def stop(self) -> np.ndarray:
        """A cell whose bound is below cannot hold anything an anchor still looks for."""
        if self.low is None:
            return self.least.min(1)
        open_ = self.low <= self.high
        return np.where(open_, self.least, 2 ** 63 - 1).min(1)

    def ceiling(self) -> np.ndarray:
        return np.full(len(self.ids), 2 ** 63 - 1) if self.low is None else self.high.max(1)


def _visit_batches(batches, anchors, cells, rows: int | None) -> Iterator[pa.RecordBatch]:
    """Each anchor's next cells: about ``rows`` rows, or all; a last row per anchor says how far it has come."""
    a = anchors.value
    stop, ceiling = a.stop(), a.ceiling()
    for batch in batches:
        for anchor in batch.column(0).to_pylist():
            popped, taken, found, bound = 0, 0, [], -np.inf
            for c1, c2, least, greatest in cells.value.visit(a.x[anchor].astype(np.float64)):
                if popped >= a.seen[anchor]:
                    if greatest < stop[anchor] or rows is not None and taken >= rows:
                        bound = greatest
                        break
                    if least <= ceiling[anchor]:
                        found.append((c1, c2))
                        taken += int(cells.value.rows[c1, c2])
                popped += 1
            found.append((-1, popped))
            pairs = np.array(found, np.int32)
            yield pa.record_batch([pa.array(np.full(len(found), anchor, np.int32)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]),
                                   pa.array(np.full(len(found), bound))], names=["anchor", "c1", "c2", "bound"])


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly."""
    reach = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * max(a.shape[1], 1)
    if reach < _EXACT:
        return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return a @ x.T


def _best(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of columns anchor, win, score, id the k first of each (anchor, win)."""
    anchor, win, score, ids = found
    order = np.lexsort((ids, -score, win, anchor))
    anchor, win, score, ids = (c[order] for c in found)
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (win[1:] != win[:-1]))) if len(anchor) else np.zeros(0, np.int64)
    place = np.arange(len(anchor)) - np.repeat(first, np.diff(np.append(first, len(anchor))))
    return [c[place < k] for c in (anchor, win, score, ids)]


def _score_batches(batches, anchors, k: int) -> Iterator[pa.RecordBatch]:
    """A task's k first rows of every anchor and window, of the cells its anchors visit."""
    a = anchors.value
    held, size = [[] for _ in range(4)], 0
    dim = a.x.shape[1]

    def best():
        kinds = (np.int32, np.int32, np.int64, np.int64)
        return _best([np.concatenate(c).astype(t) if c else np.zeros(0, t) for c, t in zip(held, kinds)], k)

    for batch in batches:
        column = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
        for row in range(batch.num_rows):
            ids = column["ids"][row].values.to_numpy()
            x = _matrix(column["vecs"].slice(row, 1), dim)
            labels = column["labels"][row].values.dictionary_encode()
            number = {v: i for i, v in enumerate(labels.dictionary.to_pylist())}
            label = labels.indices.to_numpy()
            asked = column["anchors"][row].values.to_numpy()
            for at in range(0, len(asked), 256):
                who = asked[at:at + 256]
                score = products(a.x[who], x)
                same = np.array([number.get(a.labels[i], -1) for i in who])[:, None] == label[None, :]
                other = a.ids[who][:, None] != ids[None, :]
                for win in range(a.least.shape[1]):
                    good = other & (score >= a.least[who, win][:, None])
                    good &= same if a.low is None else ~same & (score <= a.high[who, win][:, None])
                    i, j = np.nonzero(good)
                    for c, v in zip(held, (who[i], np.full(len(i), win), score[i, j], ids[j])):
                        c.append(v)
                    size += len(i)
            if size > _BUFFER:
                held = [[c] for c in best()]
                size = len(held[0][0])
    yield pa.record_batch([pa.array(c) for c in best()], names=["anchor", "win", "score", "id"])


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "win").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _rounds(parts: DataFrame, cells, anchors: Anchors, k: int, first_rows: int) -> DataFrame | None:
    """anchor, win, score, id, rank: the k first rows of every anchor and window, certified round by round."""
    spark = parts.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = None
    for turn in range(ROUNDS):
        active = np.flatnonzero(anchors.next >= anchors.stop())
        if not len(active):
            break
        rows = None if turn == ROUNDS - 1 else first_rows * GROWTH ** turn
        known = spark.sparkContext.broadcast(anchors)
        asking = spark.createDataFrame(pd.DataFrame({"anchor": active}), "anchor int").repartition(min(tasks, len(active)), "anchor")
        visits = written(asking.mapInArrow(lambda b: _visit_batches(b, known, cells, rows), "anchor int, c1 int, c2 int, bound double"), "visits")
        by_cell = visits.where("c1 >= 0").groupBy("c1", "c2").agg(F.collect_list("anchor").alias("anchors"))
        scored = parts.hint("shuffle_hash").join(by_cell, ["c1", "c2"]).mapInArrow(lambda b: _score_batches(b, known, k), _FOUND)
        found = written(_first(scored if found is None else scored.unionByName(found.drop("rank")), k), "found")
        for r in visits.where("c1 < 0").collect():  # one row per anchor of the block
            anchors.seen[r["anchor"]], anchors.next[r["anchor"]] = r["c2"], r["bound"]
        for r in found.where(F.col("rank") == k).select("anchor", "win", "score").collect():  # one per anchor and window
            anchors.least[r["anchor"], r["win"]] = max(anchors.least[r["anchor"], r["win"]], r["score"])
    return found


def _mine_block(parts: DataFrame, cells, anchors: Anchors, positives: int, k: int, first_rows: int) -> DataFrame | None:
    spark = parts.sparkSession
    near = _rounds(parts, cells, anchors, positives, first_rows)
    if near is None:
        return None
    rows = near.toPandas()  # at most ``positives`` of each anchor of the block
    scores, known = np.zeros((len(anchors.ids), positives), np.int64), np.zeros((len(anchors.ids), positives), bool)
    place = rows["anchor"].to_numpy(), rows["rank"].to_numpy() - 1
    scores[place], known[place] = rows["score"], True
    anchors.windows(scores, known)
    hard = _rounds(parts, cells, anchors, k, first_rows)
    if hard is None:
        return None
    ids = spark.createDataFrame(pd.DataFrame({"anchor": np.arange(len(anchors.ids)), "anchor_id": anchors.ids}), "anchor int, anchor_id long")
    pairs = near.select("anchor", (F.col("rank") - 1).alias("win"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (hard.join(pairs, ["anchor", "win"]).join(F.broadcast(ids), "anchor")
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))


def mine(rows: DataFrame, every: int = 100, positives: int = POSITIVES, k: int = K, first_rows: int = FIRST_ROWS, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """For each id of ``rows`` (id, label, vec) divisible by ``every`` and each of its ``positives`` nearest rows of its label the
    first k rows of other labels in the positive's window: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    rows = written(rows, "vectors")
    out = None
    for (dim,) in sorted(rows.select(F.size("vec")).distinct().collect()):  # vector lengths
        same = rows.where(F.size("vec") == dim)
        asked = same.where(F.col("id") % every == 0)
        n = -(-asked.count() * dim * 8 // anchor_bytes)
        if not n:
            continue
        parts, held = index(same, dim)
        cells = spark.sparkContext.broadcast(held)
        for part in range(n):
            block = asked.where(F.pmod(F.xxhash64("id", "vec"), F.lit(n)) == part).toPandas()  # about anchor_bytes
            if not len(block):
                continue
            block = block.sort_values(["id", "label"], kind="stable")
            anchors = Anchors(block["id"].to_numpy(), list(block["label"]), np.stack([np.asarray(v, np.int64) for v in block["vec"]]))
            found = _mine_block(parts, cells, anchors, positives, k, first_rows)
            if found is not None:
                out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out
