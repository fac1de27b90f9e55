"""Cross-site boilerplate lines by distinct-site spread, in DataFrame operations only.

Each line is known by a 128-bit hash.  HyperLogLog sketches of the sites that
hold it are made on the map side and merged by the aggregation, so a line that
a third of all rows holds moves one sketch per task.  Lines whose estimate is
near the threshold get an exact distinct count; the others are decided by
the estimate.  Boilerplate lines are then removed wherever they stand: a row's
text is known by a 128-bit hash too, the positions to drop are found once
per distinct text, and joined back.

Defined results: a NULL text stays NULL with 0 lines; an empty text is one
empty line; blank lines (spaces only) are never boilerplate; a NULL site
is no site; repeated rows are cleaned row by row and add no site; a text that
loses every line becomes empty; other columns pass through.  Lines are parted
by line feeds and compared after trimming spaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SITES = 8
#: HyperLogLog precision, and the relative band around the threshold that is counted exactly (over 4 standard errors).
LOG_REGISTERS, BAND = 10, 0.15
#: Parts that the rows of one line are dealt over where lines are looked up.
SALTS = 16


def _hashes(c: Column, a: str, b: str) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), c).alias(a), F.xxhash64(F.lit(2), c).alias(b)


def _lines(docs: DataFrame, *columns: Column) -> DataFrame:
    """One row per line that is not blank: the columns, its position and its hashes."""
    # the columns first: beside the lines they would be computed, from the whole text, for each line anew
    rows = docs.where(F.col("text").isNotNull()).select(*columns, F.split("text", "\n", -1).alias("_split"))
    every = rows.select(*(c for c in rows.columns if c != "_split"), F.posexplode("_split").alias("_at", "_line"))
    trimmed = F.trim("_line")
    return every.where(F.length(trimmed) > 0).select(*(c for c in every.columns if c != "_line"), *_hashes(trimmed, "_h1", "_h2"))


def _looked_up(lines: DataFrame, by: str, wanted: DataFrame) -> DataFrame:
    """The ``lines`` whose hashes are in ``wanted``: a line that a third of all rows hold goes to SALTS tasks, by the column ``by``."""
    salted = lines.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    every = wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(every, ["_h1", "_h2", "_salt"], "left_semi").drop("_salt")


def spread(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """_h1, _h2 of the lines held by at least ``min_sites`` distinct sites."""
    lines = _lines(docs, F.col(site).alias("_site")).where(F.col("_site").isNotNull())
    sketched = (lines.groupBy("_h1", "_h2")
                .agg(F.hll_sketch_agg(F.col("_site").cast("string"), F.lit(LOG_REGISTERS)).alias("_sketch"))
                .select("_h1", "_h2", F.hll_sketch_estimate("_sketch").alias("_sites")))
    low, high = min_sites * (1 - band) - 1, min_sites * (1 + band) + 1
    wide = sketched.where(F.col("_sites") > low)
    sure = wide.where(F.col("_sites") >= high).select("_h1", "_h2")
    near = wide.where(F.col("_sites") < high).select("_h1", "_h2")
    exact = (_looked_up(lines.select("_h1", "_h2", "_site"), "_site", near)
             .groupBy("_h1", "_h2", "_site").agg(F.lit(1).alias("_one"))
             .groupBy("_h1", "_h2").agg(F.count("*").alias("_sites"))
             .where(F.col("_sites") >= min_sites).select("_h1", "_h2"))
    return sure.unionByName(exact)


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """All columns of ``docs`` with ``text`` cleaned, and n_lines, n_removed (long)."""
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    docs = docs.select(*(F.col(f"`{c}`") for c in columns))
    dropped = (_looked_up(_lines(docs, *_hashes(F.col("text"), "_k1", "_k2")), "_k1", spread(docs, site, min_sites))
               .groupBy("_k1", "_k2").agg(F.collect_set("_at").alias("_drop")))
    rows = docs.withColumns(dict(zip(("_k1", "_k2"), _hashes(F.col("text"), "_k1", "_k2"))))
    joined = rows.join(dropped.hint("shuffle_hash"), ["_k1", "_k2"], "left").withColumn("_split", F.split("text", "\n", -1))
    # positions that stay, by one hash set; then their lines
    stay = F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), F.col("_drop"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("_split"), i)), "\n")
    text = F.when(F.col("_drop").isNull(), F.col("text")).otherwise(kept)
    return joined.select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in columns),
                         F.coalesce(F.size("_split"), F.lit(0)).cast("long").alias("n_lines"),
                         F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_removed"))
