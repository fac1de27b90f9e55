"""Feature preparation for modeling.

Task detection, label encoding, a deterministic hash split, scalers fitted
on the training rows, and class rebalancing.  All of it is DataFrame /
``pyspark.ml`` code; statistics (class lists, means, ranges) are the only
things that reach the driver.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsense.functions.columns import nan_as_missing, categorical_columns, numeric_columns, q
from tabsense.functions.labels import encode, label_dictionary
from tabsense.functions.stats import column_stats
from tabsense.operators.chartdata import md5_rank
from tabsense.operators.cleaning import MISSING_LABEL
from tabsense.session import shared_scratch

# A numeric target with more than this many distinct values is
# a regression target; test share 10-40 %, default 20 %, seed 42.
REGRESSION_MIN_UNIQUE = 12
TEST_SHARE_RANGE = (0.10, 0.40)
DEFAULT_TEST_SHARE = 0.20
DEFAULT_SEED = 42
HASH_SPACE = 2 ** 32


@nan_as_missing
def detect_task(df: DataFrame, target: str) -> DataFrame:
    """(target, is_numeric, unique_values, task).  Needs at least two
    columns (a target and a feature)."""
    if len(df.columns) < 2:
        raise ValueError("modeling needs at least 2 columns")
    is_num = isinstance(df.schema[target].dataType, T.NumericType)
    task = F.when(F.lit(is_num) & (F.col("unique_values") > REGRESSION_MIN_UNIQUE), "regression") \
        .otherwise("classification")
    return df.agg(F.count_distinct(q(target)).alias("unique_values")).select(
        F.lit(target).alias("target"), F.lit(is_num).alias("is_numeric"), "unique_values", task.alias("task"))


@nan_as_missing
def encode_labels(df: DataFrame, cols: list[str] | None = None, suffix: str = "") -> DataFrame:
    """Text columns -> 0..k-1 in sorted order of their values, missing
    cells first filled with ``Missing``.  Returns the table with the encoded
    columns (double) replacing the text."""
    cols = cols if cols is not None else categorical_columns(df)
    if not cols:
        return df
    out, _ = encode(df.na.fill(MISSING_LABEL, subset=cols), cols)
    return out.select(*[q(c).cast("double").alias(c + suffix) if c in cols else q(c) for c in df.columns])


@nan_as_missing
def encode_target(df: DataFrame, target: str, code: str = "target_code") -> DataFrame:
    """``df`` with the code (double) of a text target in the column ``code`` beside it, 0..k-1 in sorted order; rows without
    a target go.  The text is kept, so each code's class is known (:func:`target_classes`)."""
    out, _ = encode(df.where(q(target).isNotNull()), [target], [code])
    return out.withColumn(code, q(code).cast("double"))


@nan_as_missing
def target_classes(df: DataFrame, target: str) -> DataFrame:
    """I3, the inverse mapping: (code, class, rows) of a text target."""
    return label_dictionary(df, [target]).select(F.col("code").cast("double").alias("code"), F.col("value").alias("class"), F.col("count").alias("rows"))


def split_column(key: str, test: float = DEFAULT_TEST_SHARE, seed: int = DEFAULT_SEED):
    """'test' for rows whose md5 rank falls below test * 2^32, else 'train'.
    No shuffle, deterministic, equal in DuckDB."""
    if not TEST_SHARE_RANGE[0] <= test <= TEST_SHARE_RANGE[1]:
        raise ValueError("test share must be between 0.10 and 0.40")
    return F.when(md5_rank(key, seed) < F.lit(int(test * HASH_SPACE)), "test").otherwise("train")


def train_test_split(df: DataFrame, key: str, test: float = DEFAULT_TEST_SHARE,
                     seed: int = DEFAULT_SEED) -> DataFrame:
    """I4: adds ``split``.  Each row is assigned by its own key hash, so every
    class (stratum) is split at the same expected share without grouping
    rows of a class together (a class may hold a third of all rows)."""
    return df.withColumn("split", split_column(key, test, seed))


#: The 32-bit rank is cut in three steps of so many bits, so the counts of a step are a few thousand per class.
RANK_STEPS = (12, 10, 10)


@nan_as_missing
def stratified_split(df: DataFrame, key: str, label: str, test: float = DEFAULT_TEST_SHARE,
                     seed: int = DEFAULT_SEED, rank: str | None = None) -> DataFrame:
    """I4: adds ``split`` with exactly ceil(test * n) test rows, dealt to the classes of ``label`` by largest remainder.

    The test rows of a class are its first by md5 rank of ``key`` (ties by
    key).  The rank at which a class is cut is found from counts per class
    and rank prefix, 12, then 10, then 10 bits; only rows that share that very
    rank are ordered, so a class that holds a third of the rows is never
    sorted in one task; the cuts, one row per class, are broadcast, so rows
    stay where they are.  NULL is a class of its own.  ``rank`` names a column
    that already holds ``md5_rank(key, seed)``; it is not returned."""
    if not TEST_SHARE_RANGE[0] <= test <= TEST_SHARE_RANGE[1]:
        raise ValueError("test share must be between 0.10 and 0.40")
    lab = q(label)
    rows = df.withColumn("_r", q(rank) if rank else md5_rank(key, seed))
    classes = rows.groupBy(lab.alias("_c")).agg(F.count(F.lit(1)).alias("n"))  # one row per class
    every = Window.partitionBy()
    total = F.sum("n").over(every)
    wanted = F.ceil(F.lit(test) * total).cast("bigint")
    shares = classes.select("_c", (wanted * F.col("n")).alias("p"), total.alias("t"), wanted.alias("w")) \
        .select("_c", F.floor(F.col("p") / F.col("t")).alias("f"), (F.col("p") % F.col("t")).alias("rest"), "w")
    left = F.col("w") - F.sum("f").over(every)
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc("rest"), F.col("_c").asc_nulls_last()))
    cuts = shares.select("_c", (F.col("f") + F.when(place <= left, 1).otherwise(0)).alias("need")).where("need > 0") \
        .withColumn("prefix", F.lit(0).cast("bigint"))
    bits = 32
    for step in RANK_STEPS:
        bits -= step
        part = F.shiftright(F.col("_r"), bits)
        inside = rows.select(lab.alias("_k"), part.alias("_p")).join(
            F.broadcast(cuts), F.col("_k").eqNullSafe(F.col("_c")) & (F.shiftright(F.col("_p"), step) == F.col("prefix")))
        counts = inside.groupBy("_c", "need", "_p").agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("_c").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cuts = counts.withColumn("before", before).where((F.col("before") < F.col("need")) & (F.col("before") + F.col("n") >= F.col("need"))) \
            .select("_c", (F.col("need") - F.col("before")).alias("need"), F.col("_p").alias("prefix"))
    cut = rows.join(F.broadcast(cuts), lab.eqNullSafe(F.col("_c")), "left")
    at = F.col("prefix").isNotNull() & (F.col("_r") == F.col("prefix"))
    tied = cut.where(at).withColumn("_n", F.row_number().over(Window.partitionBy("_c").orderBy(q(key)))) \
        .withColumn("split", F.when(F.col("_n") <= F.col("need"), "test").otherwise("train"))
    clear = cut.where(~at).withColumn("split", F.when(F.col("_r") < F.col("prefix"), "test").otherwise("train"))
    columns = [q(c) for c in df.columns if c not in ("split", rank)] + [F.col("split")]
    return clear.select(*columns).unionByName(tied.select(*columns))


def _fit_stats(df: DataFrame, cols: list[str], kinds: list[str]) -> dict:
    train = df.where(F.col("split") == "train")
    aggs = {}
    if "standard" in kinds:
        aggs.update(m=F.avg, s=F.stddev_pop)
    if "minmax" in kinds:
        aggs.update(a=F.min, b=F.max)
    st = column_stats(train, cols, **aggs)
    return {f"{k}{i}": v for i, c in enumerate(cols) for k, v in st[c].items()}


@nan_as_missing
def scale(df: DataFrame, cols: list[str] | None = None, method: str = "standard") -> DataFrame:
    """Fit on the ``split = 'train'`` rows, apply to every row.

    standard: (x - mean) / population std (scikit-learn's scale); a column
    with zero spread is only centred.  minmax: (x - min) / (max - min); zero
    range gives 0."""
    cols = cols if cols is not None else [c for c in numeric_columns(df)]
    if method not in ("standard", "minmax"):
        raise ValueError("method must be 'standard' or 'minmax'")
    st = _fit_stats(df, cols, [method])
    exprs = {}
    for i, c in enumerate(cols):
        x = q(c).cast("double")
        if method == "standard":
            m, s = st[f"m{i}"], st[f"s{i}"]
            if m is None:
                continue
            exprs[c] = (x - F.lit(m)) / F.lit(s if s else 1.0)
        else:
            a, b = st[f"a{i}"], st[f"b{i}"]
            if a is None:
                continue
            exprs[c] = (x - F.lit(a)) / F.lit(b - a if b > a else 1.0)
    return df.select(*[exprs[c].alias(c) if c in exprs else q(c) for c in df.columns])


def class_balance(train: DataFrame, label: str) -> DataFrame:
    """I7 quotas: (class, count_before, count_after) where every class is
    brought up to the majority count."""
    counts = train.groupBy(q(label).alias("class")).agg(F.count(F.lit(1)).alias("count_before"))
    w = Window.partitionBy()  # one row per class: bounded
    return counts.select("class", "count_before", F.max("count_before").over(w).alias("count_after"))


# Synthetic rows generated by one task from one chunk of a seed row's copies.
SMOTE_CHUNK = 100_000


@nan_as_missing
def smote(train: DataFrame, label: str, features: list[str], k: int = 5, seed: int = DEFAULT_SEED,
          buckets: int | None = None) -> DataFrame:
    """Synthetic rows until every class has the majority count (exact).

    A row's partners are the ``k`` nearest other rows of its class by Euclidean distance over the features as given (a
    missing one counts as 0), exactly (:mod:`tabsense.operators.neighbours`), equal distances by the features.  Equal rows are one
    point with a count, and partners of each other at distance 0.
    The points of a class are ordered along a seeded random projection and cut into range buckets, so neither a class nor
    a repeated row is gathered into one task however large it is.  Each row of a class with n rows and deficit d seeds
    d // n synthetic rows, plus one for the first d % n rows of that order.
    A synthetic row is x + u * (partner - x) with u and the partner chosen
    by hash; a row without partners (a class of one) is replicated.
    Returns (features..., label, synthetic)."""
    from tabsense.functions.ordered_fill import order_buckets
    from tabsense.operators.neighbours import nearest
    spark = train.sparkSession
    base_cols = [q(f).cast("double").alias(f) for f in features] + [q(label).alias(label)]
    out = train.select(*base_cols, F.lit(False).alias("synthetic"))
    # one row per class, joined by value: nothing of it reaches the driver
    lacking = class_balance(train, label).where(F.col("class").isNotNull() & (F.col("count_before") < F.col("count_after"))) \
        .select(F.col("class").alias("_c"), (F.col("count_after") - F.col("count_before")).alias("_deficit"), F.col("count_before").alias("_members"),
                F.row_number().over(Window.partitionBy().orderBy("class")).alias("_k"))
    rng = random.Random(seed)
    proj = sum((F.get("_x", F.lit(i)) * F.lit(rng.uniform(-1, 1)) for i in range(len(features))), F.lit(0.0))
    # + 0.0 makes one value of both zeros
    vector = F.array(*[F.coalesce(q(f), F.lit(0.0)) + F.lit(0.0) for f in features]).alias("_x")
    path = shared_scratch(spark, "smote-points")
    train.select(*base_cols).join(lacking, q(label) == F.col("_c")).groupBy("_k", "_deficit", "_members", q(label).alias("_label"), vector) \
        .agg(F.count("*").alias("_m"), *[F.min(q(f)).alias(f"_f{i}") for i, f in enumerate(features)]) \
        .withColumn("_pid", F.monotonically_increasing_id()).withColumn("_proj", proj) \
        .withColumn("_id", F.xxhash64("_x", "_label", F.lit(seed))).write.parquet(path)
    points = spark.read.parquet(path)
    near = nearest(points.select("_k", "_pid", F.col("_x").alias("x"), F.col("_m").alias("m")), k)
    b = order_buckets(points, ["_proj"], buckets)
    per = b.groupBy(F.col("_k").alias("_ok"), F.col("_b").alias("_ob")).agg(F.sum("_m").alias("_n"))
    w_cum = Window.partitionBy("_ok").orderBy("_ob").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("_ok", "_ob", F.coalesce(F.sum("_n").over(w_cum), F.lit(0)).alias("_off"))
    w_in = Window.partitionBy("_k", "_b").orderBy("_proj", "_id", "_x").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_off") + F.coalesce(F.sum("_m").over(w_in), F.lit(0))
    ranked = b.join(offsets, (F.col("_k") == F.col("_ok")) & (F.col("_b") == F.col("_ob"))).withColumn("_rank", before)
    extra = F.greatest(F.least(F.col("_rank") + F.col("_m"), F.col("_deficit") % F.col("_members")) - F.col("_rank"), F.lit(0))
    copies = F.col("_m") * F.floor(F.col("_deficit") / F.col("_members")) + extra
    # a point's first k partner rows: its own copies, then each neighbour as often as it occurs
    own = F.array_repeat(F.col("_x"), F.least(F.col("_m") - 1, F.lit(k)).cast("int"))
    others = F.flatten(F.transform("near", lambda p: F.array_repeat(p["x"], F.least(p["m"], F.lit(k)).cast("int"))))
    ranked = ranked.join(near, ["_k", "_pid"]).withColumn("_nb", F.slice(F.concat(own, others), 1, k))
    # a seed row may owe millions of copies (a class of one next to a class
    # holding a third of the rows): cut its copies into chunks, spread the
    # chunk rows over the cluster (an explicit partition count, which AQE
    # leaves as it is), then number the copies 1..copies inside each chunk
    nparts = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seeds = ranked.where(copies > 0).withColumn("_copies", copies.cast("long"))
    nchunks = F.ceil(F.col("_copies") / F.lit(SMOTE_CHUNK)).cast("int")
    seeds = seeds.withColumn("_chunk", F.explode(F.sequence(F.lit(0), nchunks - 1)))
    seeds = seeds.repartition(nparts, F.xxhash64("_id", "_chunk"))
    start = F.col("_chunk").cast("long") * SMOTE_CHUNK + 1
    end = F.least(F.col("_copies"), start + SMOTE_CHUNK - 1)
    syn = seeds.withColumn("_copy", F.explode(F.sequence(start, end))) \
        .withColumn("_copy", F.col("_copy").cast("int"))
    h = F.xxhash64("_id", "_copy", F.lit(seed))
    nb = F.when(F.size("_nb") > 0, F.element_at("_nb", (F.pmod(h, F.greatest(F.size("_nb"), F.lit(1))) + 1).cast("int")))
    u = F.pmod(F.xxhash64(h, F.lit(seed + 1)), F.lit(1_000_000)) / 1_000_000.0
    syn = syn.select(*[F.coalesce(F.col(f"_f{i}") + u * (F.get(nb, F.lit(i)) - F.col(f"_f{i}")), F.col(f"_f{i}")).alias(f) for i, f in enumerate(features)], F.col("_label").alias(label),
                     F.lit(True).alias("synthetic"))
    return out.unionByName(syn)
