"""Exact quantiles (pandas ``linear`` = DuckDB ``quantile_cont``) at any scale.

Spark's exact ``percentile`` aggregate keeps a value->count map in a single
task, so its memory grows with the number of distinct values: fine for a
small table, fatal for a 100 TB one.  Here every exact quantile is found by
*bracket refinement*:

1. one grouped aggregate per round computes, for every open target rank, the
   number of values below its bracket and inside it, a distinct-value
   estimate and a KLL sketch of the values inside it; sketches are built per
   (bracket, salt) and merged per bracket, so no task merges every map
   task's sketch;
2. the sketch narrows each bracket by a factor of 100 or more per round; a
   bracket it can no longer narrow is halved by value;
3. once a bracket is known to hold few distinct values (or is a single one),
   one distributed ``groupBy(value).count()`` restricted to the brackets
   returns them with their counts, and the exact order statistic is read off.

Only statistics reach the driver: bracket bounds, counts and at most
``collect_bound`` (value, count) rows per target, which is checked before
they are taken; a bracket that holds more is narrowed further.  A value
repeated in a third of all rows collapses to one (value, count) row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.functions.columns import q

GRID = 256
ACCURACY = 20000
COLLECT_BOUND = 20000
KLL_K = 4096
KLL_MARGIN = 2e-3   # rank margin around a target for a KLL grid (error ~0.1 % at this k)
SALTS = 64          # sketches merged at each of the two levels: at most map tasks / SALTS, then SALTS


@dataclass
class _Target:
    col: str
    k: int                      # 0-based rank among the non-null values
    lo: float | None = None     # bracket [lo, hi]; None = unbounded
    hi: float | None = None
    est: float = math.inf       # estimated number of values in the bracket
    margin: float = KLL_MARGIN
    verified: tuple = field(default_factory=lambda: (None, None))


def _kll_round(df: DataFrame, brackets: list[tuple], probs: list[float], distinct: bool, k: int = KLL_K) -> dict:
    """{(col, lo, hi): (values below, values inside, grid of ``probs`` over those inside, distinct estimate)}, one scan."""
    structs = []
    for i, (col, lo, hi) in enumerate(brackets):
        # SQL text: one parse per bracket instead of many Py4J calls
        c = "CAST(`" + col.replace("`", "``") + "` AS DOUBLE)"
        inside = " AND ".join(([] if lo is None else [f"{c} >= {float(lo)!r}D"]) + ([] if hi is None else [f"{c} <= {float(hi)!r}D"]))
        x = f"CASE WHEN {inside} THEN {c} END" if inside else c
        below = "0L" if lo is None else f"CASE WHEN {c} < {float(lo)!r}D THEN 1L ELSE 0L END"
        structs.append(f"named_struct('position', {i}, 'x', {x}, 'b', {below})")
    long = (df.select(F.expr(f"inline(array({', '.join(structs)}))"))
            .withColumn("_s", F.spark_partition_id() % SALTS))
    aggs = [F.sum("b").alias("b"), F.expr(f"kll_sketch_agg_double(x, {int(k)})").alias("sk")]
    merges = [F.sum("b").alias("b"), F.expr("kll_merge_agg_double(sk)").alias("m")]
    if distinct:
        aggs.append(F.hll_sketch_agg(F.col("x").cast("string"), F.lit(12)).alias("h"))
        merges.append(F.hll_union_agg("h").alias("h"))
    merged = long.groupBy("position", "_s").agg(*aggs).groupBy("position").agg(*merges)
    plist = "array(" + ", ".join(f"{float(p)!r}D" for p in probs) + ")"
    rows = merged.select("position", "b", F.expr("kll_sketch_get_n_double(m)").alias("n"),
                         F.expr(f"CASE WHEN kll_sketch_get_n_double(m) > 0 "
                                f"THEN kll_sketch_get_quantile_double(m, {plist}) END").alias("g"),
                         (F.hll_sketch_estimate("h") if distinct else F.lit(None).cast("bigint")).alias("d")).collect()
    got = {r["position"]: (int(r["b"] or 0), int(r["n"]), r["g"], r["d"]) for r in rows}
    return {br: got.get(i, (0, 0, None, None)) for i, br in enumerate(brackets)}


def _kll_grid(df: DataFrame, cols: list[str], probs: list[float]) -> dict:
    """Full-range first round: {col: (0, non-null count, grid of ``probs``, None)}."""
    return {c: v for (c, _, _), v in _kll_round(df, [(c, None, None) for c in cols], probs, False).items()}


def _narrow(t, below, inb, g, distinct, grid):
    """Shrink target ``t``'s bracket around its rank using the grid; False if it stays as it is."""
    if not (below <= t.k < below + inb):
        # the approximate grid missed: back to the last verified bracket
        t.lo, t.hi = t.verified
        t.margin *= 4
        t.est = math.inf
        return True
    t.verified = before = (t.lo, t.hi)
    f = (t.k - below) / inb
    j_lo = math.floor((f - t.margin) * grid)
    j_hi = math.ceil((f + t.margin) * grid)
    if j_lo > 0:
        t.lo = float(g[j_lo])
    if j_hi < grid:
        t.hi = float(g[j_hi])
    t.est = inb * ((min(j_hi, grid) - max(j_lo, 0)) / grid + 2 * t.margin)
    if distinct is not None:
        t.est = min(t.est, 1.2 * distinct + 100)
    return (t.lo, t.hi) != before


def _halve(df, targets):
    """Halve each target's bracket by value, from exact counts."""
    aggs, mids = [], []
    for i, t in enumerate(targets):
        c = q(t.col).cast("double")
        if t.lo is None or t.hi is None:
            r = df.agg(F.min(c).alias("a"), F.max(c).alias("b")).first()
            t.lo, t.hi = t.lo if t.lo is not None else r["a"], t.hi if t.hi is not None else r["b"]
        mid = t.lo + (t.hi - t.lo) / 2
        mids.append(min(mid, math.nextafter(t.hi, -math.inf)))
        aggs += [F.count(F.when(c < F.lit(t.lo), 1)).alias(f"b{i}"), F.count(F.when(c <= F.lit(mids[i]), 1)).alias(f"m{i}"),
                 F.count(F.when(c <= F.lit(t.hi), 1)).alias(f"h{i}")]
    for at in range(0, len(targets), 10):
        row = df.agg(*aggs[3 * at:3 * at + 30]).first()
        for i, t in list(enumerate(targets))[at:at + 10]:
            below, mid, top = row[f"b{i}"], row[f"m{i}"], row[f"h{i}"]
            if t.k < mid:
                t.hi, t.est = mids[i], mid - below
            else:
                t.lo, t.est = math.nextafter(mids[i], math.inf), top - mid
            t.verified = (t.lo, t.hi)


def exact_order_stats(df: DataFrame, targets: list[tuple[str, int]], counts: dict[str, int],
                      *, grid: int = GRID, collect_bound: int = COLLECT_BOUND,
                      first_round: dict | None = None) -> dict[tuple[str, int], float]:
    """Value at each 0-based rank ``k`` of the sorted non-null values of ``col``.

    ``first_round`` may carry an already computed full-range grid per column
    ({col: (0, n, grid_values, None)}), saving one scan."""
    open_t = [_Target(c, k, est=float(counts[c])) for c, k in targets]
    result: dict[tuple[str, int], float] = {}
    probs = [j / grid for j in range(grid + 1)]
    if first_round:
        for t in open_t:
            if t.est > collect_bound and t.col in first_round:
                _narrow(t, *first_round[t.col], grid)
    while open_t:
        big = [t for t in open_t if t.est > collect_bound and not (t.lo is not None and t.lo == t.hi)]
        small = [t for t in open_t if t not in big]
        if big:
            stats = _kll_round(df, list(dict.fromkeys((t.col, t.lo, t.hi) for t in big)), probs, True)
            stuck = [t for t in big if not _narrow(t, *stats[t.col, t.lo, t.hi], grid) and t.est > collect_bound]
            if stuck:
                _halve(df, stuck)
        if small:
            _finish(df, small, result, collect_bound)
            open_t = [t for t in open_t if (t.col, t.k) not in result]
    return result


def _finish(df, small, result, collect_bound):
    """Read exact order statistics from the (value, count) rows of each bracket.

    One record per row and column: the value itself when it lies inside one
    of the column's brackets, else its gap id = the number of bracket lower
    bounds at or below it.  A value outside the brackets is below bound
    ``lows[m]`` exactly when its gap id is at most ``m``, so the counts below
    every bracket come from the few gap rows plus the exact values."""
    bycol: dict[str, list] = {}
    for t in small:
        bycol.setdefault(t.col, []).append(t)
    cols = list(bycol)
    lows_of = {}
    pre, structs = [], []
    for i, col in enumerate(cols):
        # SQL text: one parse per column instead of hundreds of Py4J calls
        c = "CAST(`" + col.replace("`", "``") + "` AS DOUBLE)"
        brackets = {(t.lo, t.hi) for t in bycol[col]}
        lows = sorted({lo for lo, _ in brackets if lo is not None})
        lows_of[col] = lows
        conds = []
        for lo, hi in brackets:
            parts = ([f"{c} >= {float(lo)!r}D"] if lo is not None else []) + \
                    ([f"{c} <= {float(hi)!r}D"] if hi is not None else [])
            conds.append("(" + (" AND ".join(parts) or "TRUE") + ")")
        inside = f"({c} IS NOT NULL AND ({' OR '.join(conds)}))"
        gap = " + ".join(f"CASE WHEN {c} >= {float(lo)!r}D THEN 1 ELSE 0 END" for lo in lows) or "0"
        # value and gap id per column first: a plain projection, split into
        # small generated methods; the array of structs below only moves them
        pre += [F.expr(f"CASE WHEN {inside} THEN {c} END AS _v{i}"),
                F.expr(f"CASE WHEN {c} IS NOT NULL AND NOT {inside} THEN {gap} END AS _g{i}")]
        structs.append(f"named_struct('p', {i}, 'v', _v{i}, 'g', _g{i})")
    # inline + where stays in generated code (a filter lambda would be interpreted)
    limit = (collect_bound + 2) * len(small) + len(cols)
    rows = (df.select(*pre).select(F.expr(f"inline(array({', '.join(structs)}))"))
            .where(F.col("v").isNotNull() | F.col("g").isNotNull())
            .groupBy("p", "v", "g").count()
            .limit(limit + 1).collect())
    if len(rows) > limit:  # an estimate was too low: nothing is taken, the brackets are narrowed by exact counts
        _halve(df, [t for t in small if t.lo is None or t.lo != t.hi])
        return
    vals: dict[int, list] = {}
    gaps: dict[int, list] = {}
    for p, v, g, n in rows:
        if v is not None:
            vals.setdefault(p, []).append((v, n))
        else:
            gaps.setdefault(p, []).append((g, n))
    for p in vals:
        vals[p].sort()
    for t in small:
        p = cols.index(t.col)
        exact = vals.get(p, [])
        if t.lo is None:
            below = 0
        else:
            m = lows_of[t.col].index(t.lo)
            below = (sum(n for g, n in gaps.get(p, []) if g <= m)
                     + sum(n for v, n in exact if v < t.lo))
        items = [(v, n) for v, n in exact
                 if (t.lo is None or v >= t.lo) and (t.hi is None or v <= t.hi)]
        total = sum(n for _, n in items)
        if not (below <= t.k < below + total):
            t.lo, t.hi = t.verified
            t.margin *= 4
            t.est = math.inf
            continue
        r = t.k - below
        acc = 0
        for v, n in items:
            acc += n
            if r < acc:
                result[(t.col, t.k)] = v
                break


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                    counts: dict[str, int] | None = None, **kw) -> dict[tuple[str, float], float | None]:
    """Linear-interpolated quantiles of each column (NULLs ignored).

    Returns {(col, p): value}; value is None for a column without values.
    """
    if not cols:
        return {}
    first_round = None
    if counts is None:
        grid = kw.get("grid", GRID)
        probs_g = [j / grid for j in range(grid + 1)]
        first_round = _kll_grid(df, cols, probs_g)
        counts = {c: first_round[c][1] for c in cols}
    targets = set()
    plan = {}
    for c in cols:
        n = counts[c]
        for p in probs:
            if n == 0:
                plan[(c, p)] = None
                continue
            h = p * (n - 1)
            lo_k, hi_k = math.floor(h), math.ceil(h)
            plan[(c, p)] = (lo_k, hi_k, h - lo_k)
            targets.add((c, lo_k))
            targets.add((c, hi_k))
    stats = exact_order_stats(df, sorted(targets), counts, first_round=first_round, **kw) if targets else {}
    out = {}
    for (c, p), spec in plan.items():
        if spec is None:
            out[(c, p)] = None
            continue
        lo_k, hi_k, frac = spec
        a, b = stats[(c, lo_k)], stats[(c, hi_k)]
        out[(c, p)] = a + (b - a) * frac if frac else a
    return out


def approx_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                     accuracy: int = ACCURACY) -> dict[tuple[str, float], float | None]:
    """One-pass approximate quantiles (rank error <= n/accuracy)."""
    if not cols:
        return {}
    row = df.agg(*[F.percentile_approx(q(c).cast("double"), probs, accuracy).alias(f"p{i}")
                   for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        vals = row[f"p{i}"]
        for j, p in enumerate(probs):
            out[(c, p)] = None if vals is None else float(vals[j])
    return out


def quantiles(df: DataFrame, cols: list[str], probs: list[float], exact: bool = True,
              counts: dict[str, int] | None = None) -> dict[tuple[str, float], float | None]:
    if exact:
        return exact_quantiles(df, cols, probs, counts=counts)
    return approx_quantiles(df, cols, probs)
