"""Aggregate-expression builders shared by the operators.

Everything here returns Spark ``Column`` expressions, so a caller can put
the statistics of many columns into a single ``agg`` (one scan, partial
aggregation on the map side, one tiny shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabsense.functions.columns import q

def null_count(name: str) -> Column:
    return F.sum(F.when(q(name).isNull(), 1).otherwise(0)).cast("bigint")


def nonnull_count(name: str) -> Column:
    return F.count(q(name))


def round_half_even(c: Column, digits: int) -> Column:
    """NumPy/pandas round half-to-even (DuckDB ``round_even``)."""
    return F.bround(c, digits)


SIG_DIGITS = 12
MAX_EXP = 22   # magnitudes from 1e22 on are left unrounded


def round_sig_sql(x: str, digits: int, sig: int = SIG_DIGITS) -> str:
    """SQL text of :func:`round_sig` for the SQL expression ``x``."""
    parts = [f"WHEN abs({x}) < 1e{sig - digits} THEN bround({x}, {digits})"]
    for e in range(sig - digits, MAX_EXP):
        parts.append(f"WHEN abs({x}) < 1e{e + 1} THEN bround({x}, {sig - 1 - e})")
    return f"CASE WHEN {x} IS NULL THEN CAST(NULL AS DOUBLE) " + " ".join(parts) + f" ELSE {x} END"


def round_sig(name: str, digits: int, sig: int = SIG_DIGITS) -> Column:
    """Half-even rounding of column ``name`` to ``digits`` decimals, but to no
    more than ``sig`` significant digits (moments of large magnitude carry
    summation-order noise in their last binary digits).  Built as SQL text:
    one expression parse instead of dozens of Py4J calls."""
    ref = "`" + name.replace("`", "``") + "`"
    return F.expr(round_sig_sql(ref, digits, sig))


def sample_skewness(x: Column, n: Column) -> Column:
    """Bias-corrected skewness (pandas ``skew``): g1*sqrt(n(n-1))/(n-2).

    Spark's ``skewness`` is the population g1 and NULL for zero variance;
    pandas gives 0 there, so zero variance with n>=3 yields 0.
    """
    g1 = F.skewness(x)
    sd = F.stddev_pop(x)
    nd = n.cast("double")
    return (F.when(n < 3, F.lit(None).cast("double"))
            .when(sd == 0, F.lit(0.0))
            .otherwise(g1 * F.sqrt(nd * (nd - 1)) / (nd - 2)))


def sample_kurtosis(x: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis (pandas ``kurtosis``):
    (n-1)/((n-2)(n-3)) * ((n+1)*g2 + 6), with g2 the population excess."""
    g2 = F.kurtosis(x)
    sd = F.stddev_pop(x)
    nd = n.cast("double")
    return (F.when(n < 4, F.lit(None).cast("double"))
            .when(sd == 0, F.lit(0.0))
            .otherwise((nd - 1) / ((nd - 2) * (nd - 3)) * ((nd + 1) * g2 + 6)))


def pairwise_corr(a: str, b: str) -> Column:
    """Pearson r over rows where both values are present (pandas ``corr``).

    Computed as covar_pop / (sd_pop*sd_pop) on the pairwise-complete values
    with ``try_divide`` so a constant column yields NULL (undefined) instead
    of the ANSI divide-by-zero error ``corr`` raises.
    """
    xa = F.when(q(b).isNotNull(), q(a).cast("double"))
    xb = F.when(q(a).isNotNull(), q(b).cast("double"))
    den = F.stddev_pop(xa) * F.stddev_pop(xb)
    return F.when(den > 0, F.try_divide(F.covar_pop(xa, xb), den))


def strength_label(r: Column, strict: bool = False) -> Column:
    """Correlation strength label: Strong / Moderate / Weak (fixed bands 0.7, 0.4)."""
    a = F.abs(r)
    if strict:
        return F.when(a > 0.7, "Strong").when(a > 0.4, "Moderate").otherwise("Weak")
    return F.when(a >= 0.7, "Strong").when(a >= 0.4, "Moderate").otherwise("Weak")


def merge_rows(*frames):
    """Combine one-row aggregate frames with disjoint columns into one row
    (union + ``max``; no join)."""
    from functools import reduce
    cols = [c for f in frames for c in f.columns]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return u.agg(*[F.max(c).alias(c) for c in cols])


def null_counts(df, cols: list[str]) -> dict[str, int]:
    """Missing cells per column in one pass: null flags unpivoted and summed
    per column position (a small buffer per key at any table width)."""
    return rows_and_null_counts(df, cols)[1] if cols else {}


def rows_and_null_counts(df, cols: list[str]) -> tuple[int, dict[str, int]]:
    """(row count, missing cells per column) from the same grouped pass; the
    row count is that of any column group (every row emits one flag per
    column)."""
    if not cols:
        return df.count(), {}
    flags = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), q(c).isNull().cast("long").alias("m"))
        for i, c in enumerate(cols)])))
    res = flags.groupBy("position").agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    got = {r["position"]: r["m"] for r in res}
    rows = res[0]["n"] if res else 0
    return rows, {c: int(got.get(i) or 0) for i, c in enumerate(cols)}


def column_stats(df, cols: list[str], **aggs) -> dict[str, dict]:
    """Per-column statistics of numeric columns in one pass, e.g.
    ``column_stats(df, cols, mean=F.avg, std=F.stddev_samp)`` ->
    ``{col: {"mean": .., "std": ..}}``.  Each aggregate receives the column's
    values as double; the values are unpivoted and grouped by column position,
    so any number of columns keeps a small aggregation buffer (codegen)."""
    from tabsense.functions.columns import unpivot_numeric
    if not cols:
        return {}
    x = F.col("x")
    rows = unpivot_numeric(df, cols).groupBy("position").agg(
        *[fn(x).alias(name) for name, fn in aggs.items()]).collect()
    got = {r["position"]: r.asDict() for r in rows}
    return {c: {name: got.get(i, {}).get(name) for name in aggs} for i, c in enumerate(cols)}


def fixed(c, decimals: int):
    """Text of a number with ``decimals`` places, rounded as C and Python do: by the double's exact binary value, exact ties to
    even.  (``format_string`` rounds the shortest decimal form half up: 0.33375, which is a little less, gives 0.3338.)

    x * 10^d = p + e exactly, with p the rounded product and e its error from splitting both factors in halves; the
    fraction of p decides, and e where that is one half.  From 2^52 / 10^d on, a double has no further places to round."""
    scale = 10.0 ** decimals
    s_split = scale * 134217729.0
    s_high = s_split - (s_split - scale)
    s_low = scale - s_high
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  a value that is used often, once

    def error(x, p):
        high = let(x * F.lit(134217729.0), lambda split: split - (split - x))
        return let(high, lambda h: ((h * F.lit(s_high) - p) + h * F.lit(s_low) + (x - h) * F.lit(s_high)) + (x - h) * F.lit(s_low))

    def rounded(x, p, whole):
        rest = p - whole.cast("double")
        tie = let(error(x, p), lambda e: (e > 0) | ((e == 0) & (whole % 2 == 1)))
        return whole + F.when((rest > 0.5) | ((rest == 0.5) & tie), F.lit(1)).otherwise(F.lit(0))

    def text(n):
        digits = F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), F.lit(decimals + 1)), F.lit("0"))
        point = F.length(digits) - decimals
        return F.concat(F.substring(digits, F.lit(1), point), F.lit("." if decimals else ""), F.substring(digits, point + 1, F.lit(decimals)))

    def shown(x):
        return let(x * F.lit(scale), lambda p: F.when(p < 2.0 ** 52, let(rounded(x, p, F.floor(p)), text)).otherwise(F.format_string(f"%.{decimals}f", x)))

    return F.when(c.isNotNull(), F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), let(F.abs(c.cast("double")), shown)))
