"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Three disjoint parts of a bounded sample of labelled rows, into which each class
is dealt by itself, serve in turn: the first weighs lexicon terms (words and their first five letters) by the log
odds of their document frequencies, the second grows the trees, the third
calibrates.  Features of a whole text: lexicon densities, nearness of lexicon
words to the second person, capitals, punctuation and obfuscation rates.
Scoring is one pass over all rows that shuffles nothing.

Defined results: a NULL or empty text is scored by its features (zeros);
without labelled rows of both classes every score is the share of toxic rows,
0.0 if there is none; repeated rows are scored row by row; NULL labels and
ids are not learned from; an input column with a name of the result is
replaced, others pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tabsense.llm.common import coded, per_text, text_blocks, words, worker_cache, written
from tabsense.llm.features import dense, list_array

#: Labelled rows learned from, and lexicon terms kept (each at most 64 characters): the bounds of what is broadcast.
SAMPLE_ROWS, LEXICON_TERMS = 20_000, 4_000
#: Least log-likelihood ratio (G2) of a term, so that chance gives none among some 100,000 terms.
MIN_EVIDENCE = 20.0
TREES, DEPTH, THRESHOLD = 20, 4, 0.5
#: Text bytes whose features are computed at a time: they take some 70 bytes for each, in every worker of an executor.
BLOCK_BYTES = 1 << 20
SECOND_PERSON = ("you your yours yourself u ur tu te ti tus vos usted ustedes toi ton ta tes vous votre du dich dir dein deine "
                 "sie ihr euch").split()
#: Signs read as the letters they stand for in a disguised word.
LOOKALIKE = str.maketrans("01345@$!", "oieasasi")
_WORDS_KEPT = 200_000


def normal(word: str) -> tuple[str, bool]:
    """The word in lower case without signs; whether signs or digits stood among its letters."""
    low = word.lower()
    if low.isalpha():
        return low, False
    inner = re.sub(r"^[^\w@$]+|[^\w@$]+$", "", low)
    if inner.isalpha() or not any(c.isalpha() for c in inner):
        return (inner if inner.isalpha() else ""), False
    plain = inner.translate(LOOKALIKE)
    return "".join(c for c in plain if c.isalpha()), True


def terms(word: str) -> list[str]:
    return [word[:64], "^" + word[:5]] if len(word) > 5 else [word] if word else []


def lexicon_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic rows, other rows) of one task."""
    seen: dict[str, list[int]] = {}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = {t for w in set((text or "").split()) for t in terms(normal(w)[0])}
            for t in own:
                seen.setdefault(t, [0, 0])[0 if toxic else 1] += 1
    keys = list(seen)
    yield pa.record_batch([pa.array(keys, pa.string()), pa.array([seen[k][0] for k in keys], pa.int64()), pa.array([seen[k][1] for k in keys], pa.int64())],
                          names=["term", "toxic", "other"])


def lexicon(sample: DataFrame, size: int = LEXICON_TERMS, evidence: float = MIN_EVIDENCE) -> dict[str, float]:
    """Weights of the terms that toxic rows of ``sample`` (text, toxic) hold more often."""
    n = sample.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    toxic, other = (n.t or 0), (n.n - (n.t or 0))
    if not toxic or not other:
        return {}
    weight = F.log(((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("other") + 0.5) / (other + 1)))
    n_term = F.col("toxic") + F.col("other")
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    g2 = 2 * (part(F.col("toxic"), n_term * toxic / n.n) + part(F.col("other"), n_term * other / n.n))
    rows = (sample.select("text", "toxic").mapInArrow(lexicon_batches, "term string, toxic long, other long")
            .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
            .where(g2 >= evidence).withColumn("w", weight).where("w > 2")
            .orderBy(F.desc("w"), F.desc("toxic"), "term").limit(size).collect())
    return {r.term: float(r.w) for r in rows}


def _weights(distinct: pa.Array, lex: dict[str, float]) -> np.ndarray:
    """Per distinct word: lexicon weight, second person, obfuscated.  A worker keeps what it has looked up."""
    kept = worker_cache("toxicity")
    if kept.get("lexicon") is not lex:
        kept.update(lexicon=lex, words={})
    cache, keys = kept["words"], distinct.to_pylist()
    if len(cache) + len(keys) > _WORDS_KEPT:
        cache.clear()
    second, out = set(SECOND_PERSON), []
    for k in keys:
        v = cache.get(k)
        if v is None:
            word, odd = normal(k.decode())
            v = cache[k] = (max((lex.get(t, 0.0) for t in terms(word)), default=0.0), float(word in second), float(odd))
        out.append(v)
    return np.array(out, float).reshape(-1, 3)


def features(data: np.ndarray, offsets: np.ndarray, lex: dict[str, float]) -> np.ndarray:
    n = len(offsets) - 1
    starts, ends, owner = words(data, offsets)
    own = np.zeros((n, 7))
    if len(starts):
        codes, distinct = coded(data, starts, ends)
        w = _weights(distinct, lex)[codes]
        count = np.maximum(per_text(np.ones(len(owner)), owner, n), 1)
        hit = w[:, 0] > 0
        total, hits = per_text(w[:, 0], owner, n), per_text(hit, owner, n)
        top = np.zeros(n)
        np.maximum.at(top, owner, w[:, 0])
        place = np.arange(len(owner))
        you = np.flatnonzero(w[:, 1] > 0)
        gap = np.full(len(owner), 1e9)
        if len(you):
            after = np.searchsorted(you, place)
            for side in (np.minimum(after, len(you) - 1), np.maximum(after - 1, 0)):
                same = owner[you[side]] == owner
                gap = np.where(same, np.minimum(gap, np.abs(you[side] - place)), gap)
        near = per_text(np.where(hit, 1 / (1 + gap), 0), owner, n)
        own = np.stack([total / count, hits / count, np.log1p(total), np.log1p(hits), top, near, per_text(w[:, 2], owner, n) / count], 1)
    return np.concatenate([own, dense(data, offsets)], 1)


def feature_batches(batches: Iterator[pa.RecordBatch], lex) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_blocks(batches, limit=BLOCK_BYTES):
        yield pa.record_batch([*(rows.column(i) for i in range(rows.num_columns)), list_array(features(data, offsets, lex.value))],
                              names=[*rows.schema.names, "_features"])


def with_features(docs: DataFrame, lex: dict[str, float]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lex)
    docs = docs.drop("_features")
    schema = StructType([*docs.schema.fields, StructField("_features", ArrayType(DoubleType()))])
    return docs.mapInArrow(lambda b: feature_batches(b, shared), schema)


class Model:
    def __init__(self, lex, trees, isotonic, share):
        self.lex, self.trees, self.isotonic, self.share = lex, trees, isotonic, share


#: A class is dealt over the parts in this order of rank: trees, calibration, lexicon, ... half of it for the lexicon.
DEAL = ("trees", "calibration", "lexicon", "trees", "lexicon", "calibration", "lexicon", "trees", "lexicon", "lexicon")


def _dealt(labels: DataFrame, sample_rows: int) -> pd.DataFrame:
    """doc_id, toxic, part, weight of at most ``sample_rows`` labelled ids, by the hash of the id: up to half of them toxic, and
    others.  A class is dealt over all three parts (one of fewer than three rows is in each); the weight makes up for the
    class's share of the labels."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(21))
    toxic = min(totals.get(1, 0), sample_rows // 2)
    out = []
    for kind, most in ((1, toxic), (0, sample_rows - toxic)):
        ids = known.where(F.col("toxic") == kind).orderBy(order, "doc_id").limit(most).select("doc_id").toPandas()["doc_id"].astype("int64")
        every = ids if len(ids) >= 3 else pd.concat([ids] * 3)
        part = [DEAL[i % len(DEAL)] for i in range(len(ids))] if len(ids) >= 3 else [p for p in DEAL[:3] for _ in range(len(ids))]
        out.append(pd.DataFrame({"doc_id": every.to_numpy(), "toxic": kind, "part": part, "weight": totals.get(kind, 0) / max(len(ids), 1)}))
    return pd.concat(out)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, trees: int = TREES, depth: int = DEPTH) -> Model:
    """Learn from rows of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), both of the training folds; an id that several
    rows have stands for one of them."""
    shared = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    present = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").join(shared.select("doc_id").distinct(), "doc_id", "left_semi")
    dealt = _dealt(present, sample_rows)
    picked = docs.sparkSession.createDataFrame(dealt, "doc_id long, toxic int, part string, weight double")
    sample = written(shared.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "part", "toxic", "weight").agg(F.min("text").alias("text")), "toxicity-sample")
    n = dealt.drop_duplicates("doc_id").groupby("toxic")["weight"].sum()
    share = float(n.get(1, 0.0) / n.sum()) if len(n) else 0.0
    lex = lexicon(sample.where("part = 'lexicon'"))
    if len(n) < 2:
        return Model(lex, None, None, share)
    rows = written(with_features(sample, lex).select("doc_id", "part", F.col("toxic").cast("double").alias("toxic"), "weight", array_to_vector("_features").alias("x"))
                   .repartition(4, "doc_id"), "toxicity-features")
    gbt = GBTClassifier(featuresCol="x", labelCol="toxic", weightCol="weight", maxIter=trees, maxDepth=depth, seed=5).fit(rows.where("part = 'trees'"))
    raw = gbt.transform(rows.where("part = 'calibration'")).select("toxic", "weight", vector_to_array("probability")[1].alias("_raw_score"))
    isotonic = IsotonicRegression(featuresCol="_raw_score", labelCol="toxic", weightCol="weight", predictionCol="_score").fit(raw)
    return Model(lex, gbt, isotonic, share)


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """All columns of ``docs``, which has a column text, and the score in column ``into``."""
    if model.trees is None:
        return docs.withColumn(into, F.lit(model.share))
    docs = docs.drop(into)
    names = ["text" if c == "text" else f"_c{i}" for i, c in enumerate(docs.columns)]  # so that no column clashes
    scored = with_features(docs.toDF(*names), model.lex)
    scored = scored.withColumn("x", array_to_vector("_features")).drop("_features")
    scored = model.trees.transform(scored).withColumn("_raw_score", vector_to_array("probability")[1])
    scored = model.isotonic.transform(scored)
    return scored.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names)),
                         F.least(F.greatest("_score", F.lit(0.0)), F.lit(1.0)).alias(into))
