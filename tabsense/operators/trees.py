"""Random forests and gradient boosting grown level by level from histograms.

The training rows are binned once.  All trees that can grow at the same time do
so in the same job: the trees of a forest, the classes of a boosting round, and
with each of them the models of every cross-validation fold.  A job sends its
rows down the trees as far as they have grown, sums (model, node, feature, bin)
histograms inside each task, adds the tasks' histograms up by (model, node) and
returns each node's best split: no row is shuffled.  Trees go into one job as
long as their open nodes' histograms stay within ``CELLS``.

Rows with equal bins cannot be told apart by a split.  Where they are few enough
beside the rows, all jobs after the first work on one record per combination of
bins with its sums, not on rows.  Where a task can hold all combinations
(``WHOLE``), it grows whole trees from them, one after another: a few of a
forest's, or all rounds of one model of boosting.  That is one job instead of
one per level; the trees are the same.

* Forest: each tree draws every row as often as a Poisson(1) number from a hash
  of the row and the tree says (summed per tree and combination, if these are at
  most a quarter of the rows and their sums at most ``DRAWN`` numbers), and every
  node looks at a random choice of features (their square root for classes, all
  for numbers); a forest predicts the mean of its trees' class shares or means.
* Boosting: trees of depth 3 on the residuals of the class probabilities (of
  the values, for regression), each leaf one Newton step times the rate.  Rows
  of equal bins, fold and class are one record with a weight (for regression,
  of equal bins and fold, with their mean: squared error needs no more).  The
  scores are written out every ``SCORE_ROUNDS`` rounds; in between they
  are computed from the trees since then.

Splits are on quantiles of each feature: ``x <= cut`` goes left.  Equal gains
go to the first feature and the least cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.functions.columns import q
from tabsense.session import shared_scratch, worker_path

#: Numbers that one task's histograms of one job may hold (96 MB); rounds of boosting between two tables of scores.
CELLS, SCORE_ROUNDS = 12 << 20, 10
BOOST_DEPTH, RATE = 3, 0.1
#: Numbers that the written draws of a forest may hold, of all combinations of bins and of one (a batch holds 10,000).
DRAWN, DRAWN_EACH = 1 << 30, 2_048
#: Numbers that a task may hold to grow whole trees from all combinations of bins (192 MB).
WHOLE = 24 << 20
#: Nodes whose histograms travel together.
NODE_BLOCK = 64
_MIN_GAIN = 1e-9  # of what the node's rows differ: below it a gain is rounding


def written(df: DataFrame, name: str) -> DataFrame:
    path = shared_scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- binning ------------------------------------------------------------------

def cut_points(rows: DataFrame, inputs: list[str], max_bins: int) -> list[np.ndarray]:
    """For each input the values at which it is cut: all but the greatest of few values, else quantiles."""
    share = [i / max_bins for i in range(1, max_bins)]
    found = rows.agg(*[F.percentile_approx(q(c), share, 10_000).alias(f"p{i}") for i, c in enumerate(inputs)],
                     *[F.approx_count_distinct(q(c), 0.02).alias(f"d{i}") for i, c in enumerate(inputs)],
                     *[F.max(q(c)).alias(f"m{i}") for i, c in enumerate(inputs)]).first()
    few = [c for i, c in enumerate(inputs) if found[f"d{i}"] <= 1.1 * max_bins]
    values: dict[str, list] = {c: [] for c in few}
    for c in few:
        values[c] = [r[0] for r in rows.select(q(c)).distinct().limit(2 * max_bins).collect()]
    cuts = []
    for i, c in enumerate(inputs):
        at = values[c] if 0 < len(values.get(c, ())) <= max_bins else found[f"p{i}"] or []
        cuts.append(np.array(sorted(v for v in set(at) if v < found[f"m{i}"]), np.float64))
    return cuts


def _bin_batches(batches, cuts) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        binned = np.empty((n, len(cuts.value)), np.int16)
        for f, cut in enumerate(cuts.value):
            binned[:, f] = np.searchsorted(cut, batch.column(3 + f).to_numpy(zero_copy_only=False))
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), _list(binned)], names=["key", "y", "fold", "bins"])


def _list(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(matrix).ravel()))


def _matrix(column: pa.ListArray, n: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


# --- trees -------------------------------------------------------------------

@dataclass
class Grown:
    """Trees as arrays by (tree, node); a node's children are 2 * node + 1 and 2 * node + 2."""
    feature: np.ndarray  # -1: a leaf
    cut: np.ndarray
    stats: np.ndarray    # (tree, node, statistic): rows, sums
    gain: np.ndarray

    @staticmethod
    def empty(trees: int, depth: int, n_stats: int) -> Grown:
        nodes = 2 ** (depth + 1) - 1
        return Grown(np.full((trees, nodes), -1, np.int16), np.zeros((trees, nodes), np.int16), np.zeros((trees, nodes, n_stats)), np.zeros((trees, nodes)))

    def leaves(self, tree: int, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node at which each row of ``bins`` ends, at most ``depth`` splits down."""
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(depth):
            f = self.feature[tree][node]
            right = bins[rows, f] > self.cut[tree][node]
            node = np.where(f < 0, node, 2 * node + 1 + right)
        return node

    def put(self, tree: int, nodes: np.ndarray, feature, cut, gain, stats, left) -> np.ndarray:
        """Takes in the splits of nodes of one level; those that split."""
        reached, split = stats[:, 0] > 0, nodes[feature >= 0]
        self.stats[tree, nodes[reached]] = stats[reached]
        self.feature[tree, nodes], self.cut[tree, nodes], self.gain[tree, nodes] = feature, cut, gain
        self.stats[tree, 2 * split + 1], self.stats[tree, 2 * split + 2] = left[feature >= 0], (stats - left)[feature >= 0]
        return split


def _hashed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POISSON = np.cumsum(np.exp(-1) / np.cumprod(np.append(1.0, np.arange(1, 16))))
_LIMITS = np.ceil(_POISSON * 2.0 ** 53).astype(np.uint64)  # of 53 bits


def draws(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often the tree draws each row."""
    mixed = _hashed(key.view(np.uint64) + _hashed(np.array([(seed << 32) + tree + 1], np.uint64))) >> np.uint64(11)
    found = np.zeros(len(mixed), np.int8)
    for limit in _LIMITS:
        more = mixed >= limit
        if not more.any():
            break
        found += more
    return found.astype(np.int64)


def choice(tree: int, node: np.ndarray, features: int, wanted: int, seed: int) -> np.ndarray:
    """For each node of a tree which features it looks at."""
    if wanted >= features:
        return np.ones((len(node), features), bool)
    at = _hashed(np.array([(seed << 32) + tree + 7], np.uint64)) + node.astype(np.uint64)[:, None] * np.uint64(features) + np.arange(features, dtype=np.uint64)
    return np.argsort(np.argsort(_hashed(at), axis=1), axis=1) < wanted


@dataclass
class Plan:
    """What a job needs to know to sum histograms."""
    kind: str                    # forest or boosting
    classes: int                 # 0: regression
    features: int
    bins: int
    folds: int                   # models: one on all rows, then one without each fold
    per_model: int               # trees of one model that grow together
    wanted: int                  # features that a node looks at
    seed: int
    centre: float = 0.0          # of the target, for regression
    start: np.ndarray | None = None  # (model, class) scores before the first tree
    drawn: bool = False          # forest: the records are combinations of bins with each tree's drawn sums
    cells: int = 0               # combinations of bins, once they are counted
    whole: int = 0               # trees that one task grows whole; 0: level by level
    step: float = 1.0            # boosting: of a leaf
    since: list = field(default_factory=list)  # boosting: (trees, leaf values) since the scores were written

    @property
    def n_stats(self) -> int:
        return 3 if self.kind == "boosting" else 1 + max(self.classes, 1)

    @property
    def outputs(self) -> int:
        """Scores of one model."""
        return 1 if self.classes <= 2 else self.classes

    @property
    def drawn_sums(self) -> tuple[int, int]:
        """(trees, sums of one tree) that a combination of bins has."""
        return self.per_model * (self.folds + 1), self.classes or 2

    @property
    def drawn_type(self) -> str:
        return "<f4" if self.classes else "<f8"  # counts of a batch's rows are exact in four bytes

    def model_of(self, tree: int) -> int:
        return tree // self.per_model


def used(plan: Plan, fold: np.ndarray, model: int) -> np.ndarray:
    return np.ones(len(fold), bool) if model == 0 else fold != model - 1


def scores_of(plan: Plan, bins: np.ndarray, written: np.ndarray | None) -> np.ndarray:
    """(row, model * output) scores."""
    score = np.repeat(plan.start.reshape(1, -1), len(bins), axis=0) if written is None else written.copy()
    for grown, value in plan.since:
        for tree in range(len(value)):
            score[:, tree] += value[tree][grown.leaves(tree, bins, BOOST_DEPTH)]
    return score


def residuals(plan: Plan, y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each output of one model misses, and the curvature there."""
    if plan.classes == 0:
        return y[:, None] - score, np.ones_like(score)
    if plan.classes == 2:
        p = 1 / (1 + np.exp(-score))
        miss = (y == 1)[:, None] - p
        return miss, p * (1 - p)
    e = np.exp(score - score.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    miss = (y[:, None] == np.arange(plan.classes)) - p
    return miss, np.abs(miss) * (1 - np.abs(miss))


def _histograms(batches, known, level: int, group: list[int]) -> Iterator[pa.RecordBatch]:
    """A task's histograms of the open nodes of the trees in ``group``: one row per (tree, node)."""
    plan, grown = known.value
    first, n_nodes, nb, s = 2 ** level - 1, 2 ** level, plan.bins, plan.n_stats
    held = np.zeros((len(group), n_nodes, plan.features, nb, s))
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        if plan.drawn:
            bins = _matrix(batch.column(0), n)
            sums = np.frombuffer(b"".join(batch.column(1).to_pylist()), plan.drawn_type).reshape(n, *plan.drawn_sums)
            for g, tree in enumerate(group):
                _add_drawn(plan, held[g], grown.leaves(tree, bins, level) - first, bins, sums[:, tree].astype(np.float64))
            continue
        key, y, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))  # boosting: weight for key
        bins = _matrix(batch.column(3), n)
        missed = {}
        if plan.kind == "boosting":
            score = scores_of(plan, bins, _matrix(batch.column(4), n) if batch.num_columns > 4 else None)
        for g, tree in enumerate(group):
            model = plan.model_of(tree)
            if plan.kind == "boosting":
                if model not in missed:
                    missed[model] = residuals(plan, y, score[:, model * plan.outputs:(model + 1) * plan.outputs])
                miss, curve = (x[:, tree % plan.per_model] for x in missed[model])
                weight = key * used(plan, fold, model)
            else:
                weight = draws(key, tree, plan.seed) * used(plan, fold, model)
            node = grown.leaves(tree, bins, level) - first
            at = np.flatnonzero((node >= 0) & (weight > 0))
            w, node = weight[at], node[at]
            size = n_nodes * nb
            for f in range(plan.features):
                cell = node * nb + bins[at, f]
                into = held[g, :, f]
                add = lambda stat, x: into[:, :, stat].__iadd__(np.bincount(cell, x, size).reshape(n_nodes, nb))
                add(0, w)
                if plan.kind == "boosting":
                    add(1, w * miss[at]), add(2, w * curve[at])
                elif plan.classes:
                    into[:, :, 1:] += np.bincount(cell * plan.classes + y[at].astype(np.int64), w, size * plan.classes).reshape(n_nodes, nb, plan.classes)
                else:
                    add(1, w * (y[at] - plan.centre))
    block = min(n_nodes, NODE_BLOCK)
    flat = held.reshape(len(group), n_nodes // block, -1)
    tree, part = np.nonzero(flat.any(-1))
    cells = [np.flatnonzero(flat[g, p]) for g, p in zip(tree, part)]  # most cells of deep nodes are empty
    yield pa.record_batch([pa.array(np.array(group)[tree], pa.int32()), pa.array(part, pa.int32()), pa.array([c.astype("<i4").tobytes() for c in cells], pa.binary()),
                           pa.array([flat[g, p][c].astype("<f8").tobytes() for g, p, c in zip(tree, part, cells)], pa.binary())],
                          names=["tree", "part", "cells", "sums"])


def _add_drawn(plan: Plan, held: np.ndarray, node: np.ndarray, bins: np.ndarray, sums: np.ndarray) -> None:
    """Adds a tree's drawn sums of combinations of bins to its histograms."""
    n_nodes, nb = held.shape[0], plan.bins
    weight = sums.sum(1) if plan.classes else sums[:, 0]
    at = np.flatnonzero((node >= 0) & (weight > 0))
    stats = np.concatenate([weight[at, None], sums[at] if plan.classes else sums[at, 1:]], 1)
    for f in range(plan.features):
        cell = node[at] * nb + bins[at, f]
        for k in range(plan.n_stats):
            held[:, f, :, k] += np.bincount(cell, stats[:, k], n_nodes * nb).reshape(n_nodes, nb)


def _draw_batches(batches, known) -> Iterator[pa.RecordBatch]:
    """One record per combination of bins in a piece of rows that are sorted by bins: how often each tree draws its rows, by
    class, or the number and the sum of their values."""
    plan = known.value
    trees, s = plan.drawn_sums
    step = max(1, CELLS // (trees * s))
    for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
        key, y, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
        bins = _matrix(batch.column(3), batch.num_rows)
        new = np.append(True, (bins[1:] != bins[:-1]).any(1))
        at, cells = np.cumsum(new) - 1, int(new.sum())
        sums = np.zeros((cells, trees, s), plan.drawn_type)
        uses = [used(plan, fold, model) for model in range(plan.folds + 1)]
        into = at * s + y.astype(np.int64) if plan.classes else at
        for tree in range(trees):
            w = draws(key, tree, plan.seed) * uses[plan.model_of(tree)]
            if plan.classes:
                sums[:, tree] = np.bincount(into, w, cells * s).reshape(cells, s)
            else:
                sums[:, tree, 0], sums[:, tree, 1] = np.bincount(at, w, cells), np.bincount(at, w * (y - plan.centre), cells)
        yield pa.record_batch([_list(bins[new]), pa.array([x.tobytes() for x in sums], pa.binary())], names=["bins", "sums"])


def drawn(rows: DataFrame, plan: Plan, depth: int = 1) -> DataFrame | None:
    """Combinations of bins with the sums that each tree draws (one may have several records), written out if they are read
    level by level; None where rows are as good.  ``plan`` is told how many combinations there are, and how many trees of ``depth`` a task can grow whole."""
    trees, s = plan.drawn_sums
    cells = rows.groupBy("bins").agg(F.count("*").alias("n"))
    found = cells.agg(F.count("*").alias("cells"), F.sum("n").alias("n")).first()
    plan.cells = found["cells"]
    plan.whole = whole_trees(plan, depth, rows.sparkSession.sparkContext.defaultParallelism)
    if not found["n"] or trees * s > DRAWN_EACH or found["cells"] * trees * s > DRAWN or (found["cells"] * 4 > found["n"] and not plan.whole):
        plan.whole = 0
        return None
    spark = rows.sparkSession
    parts = spark.sparkContext.defaultParallelism
    # a combination that holds more rows than a quarter of a task's share is dealt over all tasks (at most 4 * parts of them)
    hot = cells.where(F.col("n") > found["n"] / (4 * parts)).select(F.col("bins").alias("_hot"))
    dealt = rows.join(F.broadcast(hot), F.col("bins") == F.col("_hot"), "left").withColumn(
        "_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64("key"), F.lit(parts))).otherwise(F.lit(0)))
    known = spark.sparkContext.broadcast(plan)
    sorted_rows = dealt.repartition(parts, "bins", "_salt").sortWithinPartitions("bins").select("key", "y", "fold", "bins")
    records = sorted_rows.mapInArrow(lambda b: _draw_batches(b, known), "bins array<smallint>, sums binary")
    return records if plan.whole else written(records, "drawn")  # whole trees read them once


def weighted(rows: DataFrame, plan: Plan) -> DataFrame:
    """weight, y, fold, bins of the rows that boosting cannot tell apart, written out."""
    same = ["fold", "bins", *(["y"] if plan.classes else [])]
    found = rows.groupBy(*same).agg(F.count("*").cast("double").alias("weight"), *([] if plan.classes else [F.avg("y").alias("y")]))
    return written(found.select("weight", "y", "fold", "bins").repartition(rows.sparkSession.sparkContext.defaultParallelism), "weighted")


def best_splits(plan: Plan, histograms: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, ...]:
    """feature (-1: none), cut, gain, statistics of the rows, and of those that go left, of (node, feature, bin, statistic) sums."""
    nodes = np.arange(len(histograms))
    whole = histograms[:, 0].sum(1)
    left = np.cumsum(histograms, axis=2)[:, :, :-1]
    sums = slice(1, 2) if plan.kind == "boosting" or not plan.classes else slice(1, None)
    worth = lambda x: (x[..., sums] ** 2).sum(-1) / np.maximum(x[..., 0], 1e-300)
    right = whole[:, None, None] - left
    gain = worth(left) + worth(right) - worth(whole)[:, None, None]
    gain[(left[..., 0] < 0.5) | (right[..., 0] < 0.5) | ~features[:, :, None]] = -np.inf
    flat = gain.reshape(len(nodes), -1)
    if not flat.shape[1]:
        return np.full(len(nodes), -1), np.zeros(len(nodes), int), np.zeros(len(nodes)), whole, whole
    top = flat.max(1)
    split = top > _MIN_GAIN * np.maximum(worth(whole), 1e-300)
    first = np.argmax(flat >= (top - 1e-9 * np.abs(top))[:, None], 1)
    f, cut = np.unravel_index(first, gain.shape[1:])
    return np.where(split, f, -1), np.where(split, cut, 0), np.where(split, top, 0.0), whole, left[nodes, f, cut]


def _splits(batches, known, level: int) -> Iterator[pa.RecordBatch]:
    """Adds the tasks' histograms up and finds the nodes' splits: one row per (tree, block of nodes)."""
    plan, _ = known.value
    block = min(2 ** level, NODE_BLOCK)
    shape = (block, plan.features, plan.bins, plan.n_stats)
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for tree, part, cells, sums in zip(*(batch.column(c).to_pylist() for c in range(4))):
            into = held.setdefault((tree, part), np.zeros(int(np.prod(shape))))
            into[np.frombuffer(cells, "<i4")] += np.frombuffer(sums, "<f8")
    for (tree, part), sums in sorted(held.items()):
        nodes = 2 ** level - 1 + part * block + np.arange(block)
        found = best_splits(plan, sums.reshape(shape), choice(tree, nodes, plan.features, plan.wanted, plan.seed))
        yield pa.record_batch([pa.array([tree], pa.int32()), pa.array([int(nodes[0])], pa.int32()), *(pa.array([x.ravel().tolist()], pa.list_(k)) for x, k in zip(
            found, (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())))], names=["tree", "first", "feature", "cut", "gain", "stats", "left"])


def whole_trees(plan: Plan, depth: int, parallelism: int) -> int:
    """How many trees of a forest (models of boosting: one) a task grows whole; 0 where it cannot hold the combinations."""
    if 2 ** (depth - 1) * plan.features * plan.bins * plan.n_stats > CELLS:
        return 0
    if plan.kind == "boosting":
        return int(plan.cells * (plan.features + 4 * plan.outputs + 10) <= WHOLE)
    trees, s = plan.drawn_sums
    room = WHOLE // max(plan.cells, 1) - plan.features - 2 * plan.n_stats - 8  # for the sums that it is dealt
    return max(0, min(room // s, -(-trees // (4 * parallelism))))


def whole_tree(plan: Plan, bins: list[np.ndarray], stats: list[np.ndarray], tree: int, depth: int) -> tuple[Grown, np.ndarray]:
    """The tree of combinations with such bins (one array per feature) and statistics (one array each), and the node at which
    each of them ends."""
    grown, nb = Grown.empty(1, depth, plan.n_stats), plan.bins
    ends, at = np.zeros(len(stats[0]), np.int64), np.flatnonzero(stats[0] > 0)
    for level in range(depth):
        first, n_nodes = 2 ** level - 1, 2 ** level
        looks = choice(tree, first + np.arange(n_nodes), plan.features, plan.wanted, plan.seed)
        node, own = ends[at] - first, [x[at] for x in stats]
        held = np.zeros((n_nodes, plan.features, nb, plan.n_stats))
        for f in range(plan.features):
            # a node's sums are those of the first feature
            some = slice(None) if f == 0 or plan.wanted >= plan.features else np.flatnonzero(looks[node, f])
            cell = node[some] * nb + bins[f][at[some]]
            for k, x in enumerate(own):
                held[:, f, :, k] = np.bincount(cell, x[some], n_nodes * nb).reshape(n_nodes, nb)
        for i in range(0, n_nodes, NODE_BLOCK):
            part = slice(i, i + NODE_BLOCK)
            feature, cut, gain, whole, left = best_splits(plan, held[part], looks[part])
            grown.put(0, first + np.arange(n_nodes)[part], feature, cut, gain, whole, left)
        at = at[grown.feature[0][ends[at]] >= 0]
        if not len(at):
            break
        feature, cut, go = grown.feature[0][ends[at]], grown.cut[0][ends[at]], np.empty(len(at), bool)
        for f in range(plan.features):
            here = np.flatnonzero(feature == f)
            go[here] = bins[f][at[here]] > cut[here]
        ends[at] = 2 * ends[at] + 1 + go
    return grown, ends


_GROWN = "turn int, tree int, feature binary, cut binary, stats binary, gain binary"


def _grown_rows(turn: int, trees: list[int], grown: list[Grown]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([turn] * len(trees), pa.int32()), pa.array(trees, pa.int32()),
                            *(pa.array([getattr(g, c)[0].tobytes() for g in grown], pa.binary()) for c in ("feature", "cut", "stats", "gain"))],
                           names=["turn", "tree", "feature", "cut", "stats", "gain"])


def _deal_trees(batches, known) -> Iterator[pa.RecordBatch]:
    """Records of :func:`drawn` for the tasks that grow the trees: bins, and the sums of a task's trees."""
    plan = known.value
    trees, _ = plan.drawn_sums
    tasks = range(-(-trees // plan.whole))
    for batch in batches:
        n = batch.num_rows
        if n:
            bins = np.ascontiguousarray(_matrix(batch.column(0), n), "<i2").tobytes()
            sums = np.frombuffer(b"".join(batch.column(1).to_pylist()), plan.drawn_type).reshape(n, *plan.drawn_sums)
            if plan.classes:  # counts, in as few bytes as hold them
                sums = sums.astype("<u1" if sums.max() < 1 << 8 else "<u2" if sums.max() < 1 << 16 else "<u4")
            yield pa.record_batch([pa.array(tasks, pa.int32()), pa.array([bins] * len(tasks), pa.binary()),
                                   pa.array([sums[:, t * plan.whole:(t + 1) * plan.whole].tobytes() for t in tasks], pa.binary())], names=["task", "bins", "sums"])


def _whole_forest(batches, known, depth: int) -> Iterator[pa.RecordBatch]:
    plan = known.value
    trees, s = plan.drawn_sums
    dealt: dict[int, list] = {}
    for batch in batches:
        for task, bins, sums in zip(*(batch.column(c).to_pylist() for c in range(3))):
            dealt.setdefault(task, []).append((bins, sums))
    for task in sorted(dealt):
        own = range(task * plan.whole, min((task + 1) * plan.whole, trees))
        parts = dealt.pop(task)
        bins = np.frombuffer(b"".join(b for b, _ in parts), "<i2").reshape(-1, plan.features)
        kind = lambda b, x: f"<u{2 * plan.features * len(x) // (len(b) * len(own) * s)}" if plan.classes else plan.drawn_type  # noqa: E731, B023
        sums = np.concatenate([np.frombuffer(x, kind(b, x)).reshape(-1, len(own), s) for b, x in parts])
        parts.clear()
        columns = [np.ascontiguousarray(bins[:, f]) for f in range(plan.features)]
        for i, tree in enumerate(own):
            mine = [sums[:, i, k].astype(np.float64) for k in range(s)]
            yield _grown_rows(0, [tree], [whole_tree(plan, columns, [sum(mine), *mine] if plan.classes else mine, tree, depth)[0]])


def _whole_boosting(batches, known, depth: int, rounds: int) -> Iterator[pa.RecordBatch]:
    """All rounds of the models whose weighted records come, sorted by bins.  Combinations of bins, with the shares of the
    classes (the mean) of their rows, give the sums of the residuals."""
    plan = known.value
    dealt: dict[int, list] = {}
    for batch in batches:
        model, y, weight = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
        bins = _matrix(batch.column(3), batch.num_rows)
        for m in np.unique(model):
            dealt.setdefault(int(m), []).append((y[model == m], weight[model == m], bins[model == m]))
    for m in sorted(dealt):
        y, weight, bins = (np.concatenate(x) for x in zip(*dealt.pop(m)))
        new = np.append(True, (bins[1:] != bins[:-1]).any(1))
        at, cells = np.cumsum(new) - 1, int(new.sum())
        columns = [np.ascontiguousarray(bins[new, f]) for f in range(plan.features)]
        total = np.bincount(at, weight, cells)
        wanted = [weight * y] if not plan.classes else [weight * (y == k) for k in ([1] if plan.classes == 2 else range(plan.classes))]
        share = np.stack([np.bincount(at, x, cells) / total for x in wanted])
        score = np.repeat(plan.start[m][:, None], cells, axis=1)
        for turn in range(rounds):
            p = score if not plan.classes else 1 / (1 + np.exp(-score)) if plan.classes == 2 else np.exp(score - score.max(0))
            p = p / p.sum(0) if plan.classes > 2 else p
            own, made = [m * plan.outputs + o for o in range(plan.outputs)], []
            moved = np.empty_like(score)
            for o, tree in enumerate(own):
                grown, ends = whole_tree(plan, columns, [total, total * (share[o] - p[o]), total * (p[o] * (1 - p[o])) if plan.classes else total], tree, depth)
                moved[o] = leaf_steps(plan, grown)[0][ends]
                made.append(grown)
            score += moved
            yield _grown_rows(turn, own, made)


def leaf_steps(plan: Plan, grown: Grown) -> np.ndarray:
    """(tree, node) values of boosted trees."""
    _, miss, curve = np.moveaxis(grown.stats, -1, 0)
    return np.where(np.abs(curve) > 1e-150, plan.step * miss / np.where(curve == 0, 1, curve), 0.0)


def _grow_whole(rows: DataFrame, plan: Plan, trees: int, depth: int, rounds: int) -> list[Grown]:
    known = rows.sparkSession.sparkContext.broadcast(plan)
    if plan.kind == "forest":
        tasks = -(-trees // plan.whole)
        dealt = rows.select("bins", "sums").mapInArrow(lambda b: _deal_trees(b, known), "task int, bins binary, sums binary").repartitionById(tasks, F.col("task"))
        found = dealt.mapInArrow(lambda b: _whole_forest(b, known, depth), _GROWN)
    else:
        models = F.array(*[F.when(F.lit(m == 0) | (F.col("fold") != m - 1), F.lit(m)) for m in range(plan.folds + 1)])
        dealt = rows.select(F.explode(models).alias("model"), "y", "weight", "bins").where(F.col("model").isNotNull())
        if plan.classes:  # folds add up
            dealt = dealt.groupBy("model", "y", "bins").agg(F.sum("weight").alias("weight"))
        dealt = dealt.select("model", "y", "weight", "bins").repartitionById(plan.folds + 1, F.col("model")).sortWithinPartitions("model", "bins")
        found = dealt.mapInArrow(lambda b: _whole_boosting(b, known, depth, rounds), _GROWN)
    grown = [Grown.empty(trees, depth, plan.n_stats) for _ in range(rounds)]
    for r in found.collect():  # the trees themselves
        for c in ("feature", "cut", "stats", "gain"):
            into = getattr(grown[r["turn"]], c)[r["tree"]]
            into[...] = np.frombuffer(r[c], into.dtype).reshape(into.shape)
    known.unpersist()
    return grown


def grow(rows: DataFrame, plan: Plan, trees: int, depth: int, rounds: int = 1) -> list[Grown]:
    """``trees`` trees, level by level; where tasks grow them whole, all ``rounds`` of them."""
    if plan.whole:
        return _grow_whole(rows, plan, trees, depth, rounds)
    spark = rows.sparkSession
    grown = Grown.empty(trees, depth, plan.n_stats)
    open_nodes = np.ones(trees, np.int64)
    for level in range(depth):
        per_tree = 2 ** level * plan.features * plan.bins * plan.n_stats
        some = np.flatnonzero(open_nodes).tolist()
        width = max(1, CELLS // per_tree)
        found = []
        for at in range(0, len(some), width):
            group = some[at:at + width]
            known = spark.sparkContext.broadcast((plan, grown))
            sums = rows.mapInArrow(lambda b: _histograms(b, known, level, group), "tree int, part int, cells binary, sums binary")  # noqa: B023
            found += (sums.repartition("tree", "part").mapInArrow(lambda b: _splits(b, known, level), "tree int, first int, feature array<int>, cut array<int>, "  # noqa: B023
                      "gain array<double>, stats array<double>, left array<double>").collect())  # the trees themselves
            known.unpersist()
        open_nodes[:] = 0
        for r in found:
            feature = np.array(r["feature"])
            stats, left = (np.array(r[c]).reshape(len(feature), -1) for c in ("stats", "left"))
            split = grown.put(r["tree"], r["first"] + np.arange(len(feature)), feature, r["cut"], r["gain"], stats, left)
            open_nodes[r["tree"]] += 2 * len(split)
    return [grown]


# --- models ------------------------------------------------------------------

@dataclass
class TreeModel:
    """A forest or a boosted model with its cross-validation models."""
    plan: Plan
    inputs: list
    cuts: list
    labels: np.ndarray | None
    rounds: list            # forest: [(trees, leaf values)]; boosting: one for each round
    depth: int

    def outputs(self, bins: np.ndarray, model: int) -> np.ndarray:
        plan, n = self.plan, len(bins)
        if plan.kind == "boosting":
            score = np.repeat(plan.start[model][None, :], n, axis=0)
            for grown, value in self.rounds:
                for o in range(plan.outputs):
                    tree = model * plan.outputs + o
                    score[:, o] += value[tree][grown.leaves(tree, bins, self.depth)]
            return score
        (grown, value), = self.rounds
        total = np.zeros((n, max(plan.classes, 1)))
        for tree in range(model * plan.per_model, (model + 1) * plan.per_model):
            total += value[tree][grown.leaves(tree, bins, self.depth)]
        return total / plan.per_model

    def predict(self, bins: np.ndarray, model: int = 0) -> np.ndarray:
        out = self.outputs(bins, model)
        if not self.plan.classes:
            return out[:, 0]
        code = (out[:, 0] > 0).astype(int) if out.shape[1] == 1 else out.argmax(1)
        return self.labels[code]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` (with the inputs) and its ``prediction``."""
        model = df.sparkSession.sparkContext.broadcast(self)
        at = [df.columns.index(c) for c in self.inputs]
        schema = df.drop("features").schema
        keep = [i for i, c in enumerate(df.columns) if c != "features"]
        plain = df.select(*[q(df.columns[i]) for i in keep])
        at = [keep.index(i) for i in at]

        def scored(batches):
            for batch in batches:
                bins = np.stack([np.searchsorted(cut, batch.column(i).to_numpy(zero_copy_only=False)) for i, cut in zip(at, model.value.cuts)], 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.value.predict(bins), pa.float64())], names=[*batch.schema.names, "prediction"])

        return plain.mapInArrow(scored, schema.add("prediction", "double"))

    def held_out(self, rows: DataFrame) -> DataFrame:
        """fold, label, prediction, n: rows by the model that did not see their fold; for classes, n rows of equal bins at once."""
        model = rows.sparkSession.sparkContext.broadcast(self)

        def scored(batches):
            m = model.value
            for batch in batches:
                bins, fold = _matrix(batch.column(3), batch.num_rows), batch.column(2).to_numpy()
                out = np.zeros(batch.num_rows)
                for f in np.unique(fold):
                    out[fold == f] = m.predict(bins[fold == f], int(f) + 1)
                y = batch.column(1).to_numpy()
                yield pa.record_batch([batch.column(2), pa.array(m.labels[y.astype(int)] if m.labels is not None else y, pa.float64()), pa.array(out, pa.float64()),
                                       batch.column(0)], names=["fold", "label", "prediction", "n"])

        same = rows.withColumn("n", F.lit(1).cast("bigint")) if self.labels is None else rows.groupBy("y", "fold", "bins").agg(F.count("*").alias("n"))
        return same.select("n", "y", "fold", "bins").mapInArrow(scored, "fold int, label double, prediction double, n bigint")

    def importances(self) -> list[float]:
        """Share of each input in what the splits gain."""
        total = np.zeros(len(self.inputs))
        for grown, value in self.rounds:
            for tree in range(self.plan.per_model):
                f = grown.feature[tree]
                part = np.bincount(f[f >= 0], grown.gain[tree][f >= 0], len(self.inputs))
                total += part / part.sum() if self.plan.kind == "forest" and part.sum() > 0 else part
        return (total / total.sum() if total.sum() > 0 else total).tolist()


def binned(train: DataFrame, inputs: list[str], cuts: list[np.ndarray], labels: np.ndarray | None) -> DataFrame:
    """key, y (class number or value), fold, bins of the training rows, written out."""
    worker_path(train.sparkSession)
    label = F.col("label")
    if labels is not None:
        label = (F.array_position(F.array(*[F.lit(float(x)) for x in labels]), label) - 1).cast("double")
    context = train.sparkSession.sparkContext
    shared = context.broadcast(cuts)
    key = F.xxhash64("_key", "label", *[q(c) for c in inputs])
    plain = (train.select(key.alias("key"), label.alias("y"), F.col("fold").cast("int").alias("fold"), *[q(c) for c in inputs])
             .repartition(context.defaultParallelism, "key"))  # each level reads them: spread once over all cores
    return written(plain.mapInArrow(lambda b: _bin_batches(b, shared), "key long, y double, fold int, bins array<smallint>"), "binned")


def forest(rows: DataFrame, inputs, cuts, labels, folds: int, trees: int, depth: int, seed: int) -> TreeModel:
    classes = 0 if labels is None else len(labels)
    wanted = max(1, int(len(inputs) ** 0.5)) if classes else len(inputs)
    centre = 0.0 if classes else rows.agg(F.avg("y")).first()[0]
    plan = Plan("forest", classes, len(inputs), max(len(c) for c in cuts) + 1, folds, trees, wanted, seed, centre)
    records = drawn(rows, plan, depth)
    plan.drawn = records is not None
    grown, = grow(records if plan.drawn else rows, plan, trees * (folds + 1), depth)
    size = np.maximum(grown.stats[:, :, :1], 1e-300)
    value = grown.stats[:, :, 1:] / size + (0 if classes else centre)
    return TreeModel(plan, list(inputs), cuts, labels, [(grown, value)], depth)


def _start(rows: DataFrame, plan: Plan) -> np.ndarray:
    """(model, output) scores before the first round: the mean, or the logarithms of the classes' odds or shares."""
    counts = rows.groupBy("fold", *(["y"] if plan.classes else [])).agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect()
    start = np.zeros((plan.folds + 1, plan.outputs))
    for model in range(plan.folds + 1):
        kept = [r for r in counts if model == 0 or r["fold"] != model - 1]
        n = sum(r["n"] for r in kept)
        if not plan.classes:
            start[model] = sum(r["s"] for r in kept) / n
            continue
        share = np.clip([sum(r["n"] for r in kept if r["y"] == k) / n for k in range(plan.classes)], 1e-15, 1)
        start[model] = np.log(share[1] / share[0]) if plan.outputs == 1 else np.log(share)
    return start


def boosting(rows: DataFrame, inputs, cuts, labels, folds: int, rounds: int, seed: int, rate: float = RATE) -> TreeModel:
    classes = 0 if labels is None else len(labels)
    plan = Plan("boosting", classes, len(inputs), max(len(c) for c in cuts) + 1, folds, 1 if classes <= 2 else classes, len(inputs), seed)
    plan.start = _start(rows, plan)
    made, state = [], weighted(rows, plan)
    plan.step = rate * ((classes - 1) / classes if classes > 2 else 1.0)
    plan.cells = state.select("bins").distinct().count()
    plan.whole = whole_trees(plan, BOOST_DEPTH, 1)
    if plan.whole:
        grown = grow(state, plan, (folds + 1) * plan.outputs, BOOST_DEPTH, rounds)
        return TreeModel(plan, list(inputs), cuts, labels, [(g, leaf_steps(plan, g)) for g in grown], BOOST_DEPTH)
    for turn in range(rounds):
        grown, = grow(state, plan, (folds + 1) * plan.outputs, BOOST_DEPTH)
        value = leaf_steps(plan, grown)
        made.append((grown, value))
        plan.since = [*plan.since, (grown, value)]
        if len(plan.since) == SCORE_ROUNDS and turn + 1 < rounds:
            state = _scored(state, plan)
            plan.since = []
    plan.since = []
    return TreeModel(plan, list(inputs), cuts, labels, made, BOOST_DEPTH)


def _scored(state: DataFrame, plan: Plan) -> DataFrame:
    """The weighted records with their scores so far, written out."""
    known = state.sparkSession.sparkContext.broadcast(plan)

    def scored(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                score = scores_of(known.value, _matrix(batch.column(3), n), _matrix(batch.column(4), n) if batch.num_columns > 4 else None)
                yield pa.record_batch([*batch.columns[:4], _list(score)], names=["weight", "y", "fold", "bins", "scores"])

    return written(state.mapInArrow(scored, "weight double, y double, fold int, bins array<smallint>, scores array<double>"), "scores")
