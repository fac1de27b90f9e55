"""N-gram Jaccard join by filtering under several global token orders.

A text's set holds its distinct five-word shingles (64-bit hashes); two texts
link when 100 * |intersection| >= 80 * |union|.  If they link, at most
n // 5 shingles of a set of n are missing from the other, so under any global
order the first s shared shingles lie within the first n // 5 + s of both.

1. Order A, all texts: the first n // 5 + s shingles, s = 1 + n // 10.  A text
   stays if enough of these occur elsewhere.  The occurrences are summed by
   shingle; what is shared is a bitmap of bounded size, which never loses one.
2. Whole sets of what stayed: 80 % of a set must occur in other texts.
3. Candidates share a shingle within the first n // 5 + 1 under the order
   rare first (the power of two of a shingle's texts, then its hash), early
   enough in both for their sizes, and s within the first n // 5 + s under
   each of the hash orders B and C; only then do texts move, and whole sets
   are verified.  A shingle's texts are not paired with each other: first with
   the one whose shingles are most common, then with the least and with one
   that differs by shingle; only what is still in different components of a
   shingle's texts is paired in full, except within the largest component.

Equal texts are one node (a 64-bit hash of the text), so copies cost one row.

Defined results: a NULL or empty text, or one without words, has 0 shingles,
links with nothing and is its own component; a NULL doc_id does not count as
the smallest id and repeated rows are one node; other columns are ignored
(``deduplicate`` passes them on).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsense.llm.common import coded, text_blocks, words, written

WORDS = 5
#: Bits of a broadcast bitmap: 8 per item, 32 MB at most; those of the levels together hold at most twice the first one's items.
BITS_PER_ITEM, MIN_BITS, MAX_BITS = 8, 1 << 15, 1 << 28
_CHUNK_BITS = 32_768  # of one row of bitmap_construct_agg
_ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd factors: orders B and C


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct shingle hashes in ascending order, which is order A."""
    low = data.copy()
    low[(low >= 65) & (low <= 90)] += 32
    starts, ends, owner = words(low, offsets)
    codes, distinct = coded(low, starts, ends)
    n = len(offsets) - 1
    if not len(codes):
        return [np.zeros(0, np.uint64)] * n
    word = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in distinct.to_pylist()), np.uint64, len(distinct))[codes]
    bounds = np.searchsorted(owner, np.arange(n + 1))
    h = word.copy()
    for k in range(1, WORDS):
        h[:-k] = _mix(h[:-k] * np.uint64(0x9FB21C651E98DF25) + word[k:]) if len(h) > k else h[:-k]
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(h[a:b - WORDS + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(word[a:b].tobytes(), seed=b - a)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets link."""
    n, m = len(a), len(b)
    if not n or not m or 5 * min(n, m) < 4 * max(n, m):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (n + m - both)


def _spare(n: int) -> int:
    return 1 + n // 10


def _lists(parts: list[np.ndarray]) -> pa.Array:
    sizes = np.append(0, np.cumsum([len(p) for p in parts]))
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))


def _sketch_batches(batches) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_blocks(batches):
        sets = shingle_sets(data, offsets)
        yield pa.record_batch([rows.column(0), rows.column(1), pa.array([len(s) for s in sets], pa.int64()),
                               _lists([s[:len(s) // 5 + _spare(len(s))] for s in sets])], names=["doc_id", "key", "n", "head"])


def _set_batches(batches) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_blocks(batches):
        yield pa.record_batch([rows.column(0), _lists(shingle_sets(data, offsets))], names=["key", "items"])


class Bitmap:
    """Of integers, by their lowest bits: never says no to a member."""

    def __init__(self, bits: int, chunks):
        self.mask = np.uint64(bits - 1)
        self.bytes = np.zeros(bits // 8, np.uint8)
        for chunk, raw in chunks:
            raw = np.frombuffer(raw, np.uint8)[:len(self.bytes)]
            self.bytes[(chunk - 1) * _CHUNK_BITS // 8:][:len(raw)] |= raw

    def has(self, items: np.ndarray) -> np.ndarray:
        at = items.astype(np.uint64) & self.mask
        return (self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


class Levels:
    """How often an integer occurs, as a power of two, from one bitmap for each: a function of the integer alone."""

    def __init__(self, bitmaps: list[Bitmap]):
        self.bitmaps = bitmaps

    def of(self, items: np.ndarray) -> np.ndarray:
        level = np.zeros(len(items), np.int64)
        for bitmap in self.bitmaps:
            level += bitmap.has(items)
        return level


def _bitmaps(items: DataFrame) -> dict[int, Bitmap]:
    """A bitmap of the longs ``item`` for each ``level``; its size follows their number up to MAX_BITS."""
    counts = {r["level"]: r["n"] for r in items.groupBy("level").agg(F.count("*").alias("n")).collect()}
    bits = {k: min(max(1 << (BITS_PER_ITEM * n - 1).bit_length(), MIN_BITS), MAX_BITS) for k, n in counts.items()}
    if not bits:
        return {}
    masks = F.create_map(*[x for k, n in bits.items() for x in (F.lit(k), F.lit(n - 1).cast("long"))])
    place = F.col("item").bitwiseAND(masks[F.col("level")]) + 1  # Spark numbers bits from 1
    chunks = (items.select("level", place.alias("at")).groupBy("level", F.bitmap_bucket_number("at").alias("chunk"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("raw")).collect())  # bits / 8 bytes
    return {k: Bitmap(n, [(r["chunk"], bytes(r["raw"])) for r in chunks if r["level"] == k]) for k, n in bits.items()}


def bitmap_of(items: DataFrame, item: str):
    """Broadcast bitmap of a column of longs."""
    made = _bitmaps(items.select(F.col(item).alias("item"), F.lit(0).alias("level")))
    return items.sparkSession.sparkContext.broadcast(made.get(0) or Bitmap(MIN_BITS, []))


def levels_of(counted: DataFrame):
    """Broadcast levels of (token, n): one for n of 2 and 3, two up to 7, and so on."""
    steps = F.sequence(F.lit(1), F.floor(F.log2(F.col("n"))).cast("int"))
    made = _bitmaps(counted.select(F.col("token").alias("item"), F.explode(steps).alias("level")))
    return counted.sparkSession.sparkContext.broadcast(Levels(list(made.values())))


def _shared(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > 1)


def _stay_batches(batches, shared) -> Iterator[pa.RecordBatch]:
    """Keys of sketches of which enough occur elsewhere: as many as a partner of the least possible size must share."""
    for batch in batches:
        n, heads = batch.column(1).to_numpy(), batch.column(2)
        bounds = heads.offsets.to_numpy().astype(np.int64)
        flat = heads.flatten().to_numpy() if len(heads) else np.zeros(0, np.int64)
        hits = np.append(0, np.cumsum(shared.value.has(flat)))
        bounds = bounds - bounds[0]
        least = -(-4 * n // 5)
        stay = (hits[bounds[1:]] - hits[bounds[:-1]] >= 1 + least // 10) & (n > 0)
        yield pa.record_batch([pa.array(batch.column(0).to_numpy()[stay])], names=["key"])


def _int_lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.append(0, np.cumsum([len(p) for p in parts]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.int32()))


def _whole_batches(batches, levels) -> Iterator[pa.RecordBatch]:
    """Of the texts of which 80 % of the whole set occur elsewhere: what may occur elsewhere of their n // 5 + 1 rarest, with
    its places; the n // 5 + s first under the orders B and C, in 32 bits, and how many of them a link needs; the more a text's shingles are common ones, the less
    is ``unlike``."""
    for rows, data, offsets in text_blocks(batches):
        keys, sizes, tokens, places, unlike, heads, needs = [], [], [], [], [], ([], []), []
        for key, s in zip(rows.column(0).to_pylist(), shingle_sets(data, offsets)):
            level = levels.value.of(s)
            if len(s) and 5 * (level > 0).sum() >= 4 * len(s):
                first = len(s) // 5 + 1
                head = np.lexsort((s, level))[:first]
                place = np.flatnonzero(level[head] > 0)
                keys.append(key), sizes.append(len(s)), unlike.append(-int(1000 * level.mean()))
                tokens.append(s[head[place]]), places.append(place)
                spare = 1 + len(s) // 5
                length = len(s) // 5 + spare
                for out, factor in zip(heads, _ORDERS):
                    ranked = np.partition(s * np.uint64(factor), length - 1)[:length]
                    out.append(np.unique((ranked >> np.uint64(32)).astype(np.uint32)).view(np.int32))
                needs.append(spare - length + min(len(out[-1]) for out in heads))  # those equal in 32 bits count once
        yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(unlike, pa.int64()), _lists(tokens),
                               _int_lists(places), *(_int_lists(h) for h in heads), pa.array(needs, pa.int64())],
                              names=["key", "n", "unlike", "tokens", "places", "b", "c", "need"])


def _linked_batches(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in text_blocks([batch], "text_a"):
            left = shingle_sets(data, offsets)
            right = [s for _, d, o in text_blocks([rows], "text_b", 1 << 62) for s in shingle_sets(d, o)]
            ok = np.array([linked(a, b) for a, b in zip(left, right)], bool)
            yield pa.record_batch([rows.column(0), rows.column(1), pa.array(ok)], names=["a", "b", "ok"])


def _ordered(pairs: DataFrame, orders: DataFrame) -> DataFrame:
    """The pairs that also share enough prefix shingles under order B and under order C: no text has moved yet."""
    of = lambda x: orders.select(F.col("key").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("b", "c", "need")))
    need = F.greatest(F.least("need_a", "need_b"), F.lit(1))
    enough = [F.size(F.array_intersect(f"{c}_a", f"{c}_b")) >= need for c in ("b", "c")]
    return pairs.join(of("a"), "a").join(of("b"), "b").where(enough[0] & enough[1]).select("a", "b")


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b of ``pairs`` with whether they link."""
    left = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    return (left.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
            .select("a", "b", "text_a", "text_b").mapInArrow(_linked_batches, "a long, b long, ok boolean"))


def connected(links: DataFrame) -> DataFrame:
    """key and root, its component's least key, of every key in ``links`` (a, b), by alternating large and small stars."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        edges = written(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("key"), F.col("v").alias("root"))
        seen = now


def _key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _pairs(rows: DataFrame, to: DataFrame, tested: DataFrame | None) -> DataFrame:
    """Distinct pairs of a row and one of ``to`` (token, other, other_n, other_pos, other_root) in another component, not tested
    before, that may link by size and place: they link with at least 4 / 9 of both sizes in common, so their first common
    shingle has at most the rest of each before it."""
    common = "((4 * (n + other_n) + 8) div 9)"
    found = (rows.join(to, "token").where(f"root <> other_root and 5 * least(n, other_n) >= 4 * greatest(n, other_n) "
                                          f"and pos <= n - {common} and other_pos <= other_n - {common}")
             .select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct())
    return found if tested is None else found.join(tested.select("a", "b"), ["a", "b"], "left_anti")


def nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, key, n of every row; key and root of the keys that link with another key)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(F.col("text")).alias("key"), "text")
    sketch = written(keyed.mapInArrow(_sketch_batches, "doc_id long, key long, n long, head array<long>"), "sketch")
    shared = bitmap_of(written(_shared(sketch.select(F.explode("head").alias("token"))), "shared"), "token")
    stay = sketch.select("key", "n", "head").mapInArrow(lambda b: _stay_batches(b, shared), "key long").distinct()
    chosen = bitmap_of(written(stay, "stay"), "key")

    @F.pandas_udf("boolean")
    def member(keys: pd.Series) -> pd.Series:
        return pd.Series(chosen.value.has(keys.to_numpy()))

    texts = written(keyed.select("key", "text").where(member("key")).groupBy("key").agg(F.first("text").alias("text")), "texts")
    items = texts.mapInArrow(_set_batches, "key long, items array<long>").select(F.explode("items").alias("token"))
    whole = levels_of(written(_shared(items), "shared-whole"))
    heads = written(texts.mapInArrow(lambda b: _whole_batches(b, whole),
                                     "key long, n long, unlike long, tokens array<long>, places array<int>, b array<int>, c array<int>, need long"), "heads")
    rows = (heads.select("key", "n", "unlike", F.explode(F.arrays_zip(F.col("tokens").alias("token"), F.col("places").alias("pos"))).alias("x"))
            .select("key", "n", "unlike", "x.token", F.col("x.pos").cast("long").alias("pos")))
    orders = heads.select("key", "b", "c", "need")

    root_of, links, tested = None, None, None
    # the most usual text of near copies is the likeliest to link with the others: their edits differ, what they left does not
    centres = {"usual": F.struct("unlike", "key"), "least": F.struct("key"), "mixed": F.struct(F.xxhash64("key", "token"))}
    for step in (*centres, "rest"):
        active = rows.withColumn("root", F.col("key")) if root_of is None else (
            rows.join(root_of, "key", "left").withColumn("root", F.coalesce("root", "key")))
        several = active.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
        active = written(active.join(several, "token", "left_semi"), "active")
        if active.isEmpty():
            break
        if step == "rest":
            main = (active.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token")
                    .agg(F.max(F.struct("c", "root")).alias("x")).select("token", F.col("x.root").alias("main")))
            minor = active.join(main, "token").where("root <> main").drop("main")
            to = active.select("token", F.col("key").alias("other"), F.col("n").alias("other_n"), F.col("pos").alias("other_pos"), F.col("root").alias("other_root"))
            pairs = _pairs(minor, to, tested)
        else:
            one = F.min(F.struct(centres[step].alias("order"), "key", "n", "root", "pos"))
            to = active.groupBy("token").agg(one.alias("x")).select("token", F.col("x.key").alias("other"), F.col("x.n").alias("other_n"),
                                                                    F.col("x.pos").alias("other_pos"), F.col("x.root").alias("other_root"))
            pairs = _pairs(active, to, tested)
        done = written(_verify(_ordered(pairs, orders), texts), "verified")
        tested = done if tested is None else tested.unionByName(done)
        new = done.where("ok").select("a", "b")
        if new.isEmpty():
            continue
        links = new if links is None else links.unionByName(new)
        root_of = connected(links)
    return sketch.select("doc_id", "key", "n"), root_of


def _classes(rows: DataFrame, root_of: DataFrame | None) -> DataFrame:
    if root_of is None:
        return rows.withColumn("root", F.col("key"))
    return rows.join(root_of, "key", "left").withColumn("root", F.coalesce("root", "key"))


def join(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id."""
    rows, root_of = nodes(docs)
    per_key = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    classes = written(_classes(per_key, root_of), "classes")
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    component = classes.join(least, "root").select("key", "component_id")
    return (rows.join(component, "key", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each component the row with the smallest doc_id (a NULL id last);
    every row without words stays; of equal (doc_id, text) rows one."""
    rows, root_of = nodes(docs)
    last = F.lit(2 ** 63 - 1).cast("long")
    per_key = rows.where("n > 0").groupBy("key").agg(F.min(F.coalesce("doc_id", last)).alias("_id"))
    best = (_classes(per_key, root_of).groupBy("root").agg(F.min(F.struct("_id", "key")).alias("x")).select("x._id", F.col("x.key").alias("_key")))
    kept = best.unionByName(rows.where("n = 0").select(F.coalesce("doc_id", last).alias("_id"), F.col("key").alias("_key")).distinct())
    names = [f"_c{i}" for i in range(len(docs.columns))]
    place = {c: n for c, n in zip(docs.columns, names)}
    ids = docs.toDF(*names).withColumns({"_id": F.coalesce(F.col(place["doc_id"]).cast("long"), last), "_key": _key(F.col(place["text"]))})
    return (ids.join(kept, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"])
            .select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names))))
