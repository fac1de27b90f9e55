"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of every word of every training row.  A task sums
its rows by (language, bucket) before anything is shuffled; the sums make a
languages x buckets matrix of log probabilities, whose size is fixed by two
parameters, which is broadcast.  Scoring treats a block of texts as a sparse
text x word matrix: a distinct word is scored once, a text adds up its words.

Defined results: ``und`` with score 0 where the text is NULL or holds no
letter, and everywhere if nothing was learned; ties go to the language first
in alphabetical order; rows with a NULL language are not learned from; equal
ids are predicted row by row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.llm.common import coded, text_blocks, words

ORDERS, BUCKETS, SMOOTHING = (1, 2, 3, 4), 1 << 15, 0.5
MAX_LANGUAGES = 256
#: Distinct words whose n-grams are held at a time.
WORDS_AT_ONCE = 30_000
UNDETERMINED = "und"

_ALPHA: list[np.ndarray] = []


def _alpha() -> np.ndarray:
    """Whether each code point is a letter (built once per worker)."""
    if not _ALPHA:
        _ALPHA.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _ALPHA[0]


def ngrams(distinct: pa.Array, orders=ORDERS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each n-gram, distinct word it belongs to, whether each distinct word has a letter).

    Signs and digits part letter runs; the place before and after a run counts as one character of an n-gram.
    """
    text = "\n" + "\n".join(x.decode() for x in distinct.to_pylist()) + "\n"
    lower = text.lower()
    if lower.count("\n") != len(distinct) + 1:
        raise ValueError("a word holds a line feed")
    points = np.frombuffer(lower.encode("utf-32-le"), np.uint32)
    letter = _alpha()[points]
    owner = np.cumsum(points == 10) - 1
    has = np.zeros(len(distinct) + 1, bool)
    has[owner[letter]] = True
    sign = np.where(letter, points, 0).astype(np.uint64)
    found, of = [], []
    for n in orders:
        if len(points) < n:
            continue
        if n == 1:
            inside = letter
        elif n == 2:
            inside = letter[:-1] | letter[1:]
        else:
            inside = np.logical_and.reduce([letter[k:len(letter) - n + 1 + k] for k in range(1, n - 1)])
        at = np.flatnonzero(inside)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h * np.uint64(0x100000001B3)) ^ sign[at + k]
        h *= np.uint64(0x9E3779B97F4A7C15)
        found.append((h >> np.uint64(40)).astype(np.int64) % buckets)
        of.append(owner[np.where(letter[at] & (n < 3), at, at + 1)] if n > 1 else owner[at])
    return np.concatenate(found), np.concatenate(of), has[:len(distinct)]


def gram_blocks(distinct: pa.Array, orders, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, slice, np.ndarray]]:
    """The n-grams of WORDS_AT_ONCE distinct words at a time: buckets, words, the words' place, which have a letter."""
    for at in range(0, len(distinct), WORDS_AT_ONCE):
        some = distinct.slice(at, WORDS_AT_ONCE)
        bucket, of, has = ngrams(some, orders, buckets)
        yield bucket, of, slice(at, at + len(some)), has


def train_batches(batches: Iterator[pa.RecordBatch], orders, buckets: int) -> Iterator[pa.RecordBatch]:
    """(language, bucket, n): this task's n-gram counts; bucket -1 counts rows."""
    sums: dict[str, np.ndarray] = {}
    for rows, data, offsets in text_blocks(batches):
        starts, ends, owner = words(data, offsets)
        codes, distinct = coded(data, starts, ends)
        langs = rows.column(rows.schema.get_field_index("lang")).dictionary_encode()
        names, lang = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        times = []
        for i, name in enumerate(names):
            times.append(np.bincount(codes[lang[owner] == i], minlength=len(distinct)))
            sums.setdefault(name, np.zeros(buckets + 1))[-1] += (lang == i).sum()
        for bucket, of, place, _ in gram_blocks(distinct, orders, buckets):
            for name, mine in zip(names, times):
                sums[name][:-1] += np.bincount(bucket, weights=mine[place][of], minlength=buckets)
    for name, own in sums.items():
        at = np.flatnonzero(own)
        yield pa.record_batch([pa.array([name] * len(at)), pa.array(np.where(at == buckets, -1, at), pa.int64()), pa.array(own[at].astype(np.int64))],
                              names=["lang", "bucket", "n"])


class Model:
    def __init__(self, languages: list[str], log_p: np.ndarray, prior: np.ndarray, orders):
        self.languages, self.log_p, self.prior, self.orders = languages, log_p, prior, orders


def train(docs: DataFrame, orders=ORDERS, buckets: int = BUCKETS, smoothing: float = SMOOTHING, max_languages: int = MAX_LANGUAGES) -> Model:
    """Learn from every row of ``docs`` (text, lang) with a language."""
    rows = (docs.where(F.col("lang").isNotNull()).select("text", "lang")
            .mapInArrow(lambda b: train_batches(b, orders, buckets), "lang string, bucket long, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).limit(max_languages * (buckets + 1) + 1).toPandas())
    languages = sorted(rows["lang"].unique())
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} languages: raise max_languages")
    counts, texts = np.full((len(languages), buckets), smoothing), np.zeros(len(languages))
    place = rows["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64)
    bucket, n = rows["bucket"].to_numpy(np.int64), rows["n"].to_numpy(np.float64)
    counts[place[bucket >= 0], bucket[bucket >= 0]] += n[bucket >= 0]
    texts[place[bucket < 0]] = n[bucket < 0]
    log_p = np.log(counts / counts.sum(1, keepdims=True)) if len(languages) else counts
    prior = np.log(texts / texts.sum()) if len(languages) else texts
    return Model(languages, np.ascontiguousarray(log_p.T, np.float32), prior, orders)


def predict_batches(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m = model.value
    names = np.array([*m.languages, UNDETERMINED], object)
    for rows, data, offsets in text_blocks(batches):
        n = rows.num_rows
        starts, ends, owner = words(data, offsets)
        codes, distinct = coded(data, starts, ends)
        best, score = np.full(n, len(m.languages)), np.zeros(n)
        if len(codes) and m.languages:
            word, has = np.zeros((len(m.languages), len(distinct))), np.zeros(len(distinct), bool)
            for bucket, of, place, letters in gram_blocks(distinct, m.orders, len(m.log_p)):
                hits, has[place] = m.log_p[bucket], letters
                for k in range(len(m.languages)):
                    word[k, place] = np.bincount(of, weights=hits[:, k], minlength=len(letters))
            total = np.stack([np.bincount(owner, weights=word[k][codes], minlength=n) for k in range(len(m.languages))], 1) + m.prior
            total = np.exp(total - total.max(1, keepdims=True))
            total /= total.sum(1, keepdims=True)
            known = np.bincount(owner, weights=has[codes], minlength=n) > 0
            best = np.where(known, total.argmax(1), len(m.languages))
            score = np.where(known, total.max(1), 0.0)
        yield pa.record_batch([*(rows.column(i) for i in range(rows.num_columns - 1)), pa.array(names[best], pa.string()), pa.array(score)],
                              names=[*rows.schema.names[:-1], "lang_pred", "score"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Every row's doc_id and held_out with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(
        lambda b: predict_batches(b, shared), "doc_id long, held_out boolean, lang_pred string, score double")
