"""Ranked lexical search over a length-stratified index.

A term weighs w = floor(1000 * ln((2N + 2) / (2df + 1))); a document with n
terms has the normaliser m = 25 + (75 * n * N) div L, and each of a term's tf
occurrences give the impact (10^9 * tf) div (1000 * tf + 8 * m).  A query's
score is the sum of w * impact over its terms, repeats included.

1. One pass over the texts counts n and the occurrences of the asked terms; N,
   L and df come from it, over all documents.
2. Documents of equal m are a stratum, range partitioned by m and a hash, so
   that one length held by a third of the rows is spread too; a stratum is cut
   into blocks of a bounded number of documents.  A block keeps its postings by
   term and tf: as m is one number there, an impact is computed once per tf.
3. A block's bound for a query is the sum of w * impact at the greatest tf of
   each of its terms.  A query visits the blocks with the highest bounds first,
   then what its kth score so far leaves: no other block can hold a document
   that belongs to the k highest.

Queries go in blocks of a bounded number of terms, which are broadcast; the
documents stay where they are, and only (query, block) visits, blocks and each
visit's k best are shuffled.

Terms are runs of ASCII letters and digits and of all other characters, A-Z in
lower case.  Defined results: a NULL or empty text has no term, so it counts in
nothing and is never found; each row of the documents is one, also with a
repeated or NULL doc_id (last among ties); equal (item_id, text) rows of the
queries are one; a query without a term that occurs gives no row; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsense.llm.common import NOT_ALNUM, coded, gather, lowered, text_blocks, words, written

K = 10
#: (query, term) rows of about one block of queries; documents of one block of a stratum at most.
QUERY_TERMS, BLOCK_DOCS = 50_000, 1024
#: Blocks that a query visits in each of the first rounds; the last one visits all that its kth score leaves.
FIRST_VISITS = (8, 128)
_EXACT = 2 ** 53  # sums of whole doubles are exact below


def _counts(data: np.ndarray, offsets: np.ndarray, ids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text; then text, term id and occurrences, ascending, of the terms that ``ids`` numbers."""
    starts, ends, owner = words(data, offsets, NOT_ALNUM)
    n = len(offsets) - 1
    codes, distinct = coded(lowered(data), starts, ends)
    number = ids(distinct.to_pylist())
    width = int(number.max(initial=0)) + 1
    term = number[codes] if len(codes) else np.zeros(0, np.int64)
    pair, tf = np.unique(owner[term >= 0] * width + term[term >= 0], return_counts=True)
    return np.bincount(owner, minlength=n), pair // width, pair % width, tf


def _query_batches(batches) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_blocks(batches):
        terms: list[bytes] = []
        _, text, term, tf = _counts(data, offsets, lambda found: (terms.extend(found), np.arange(len(found)))[1])
        yield pa.record_batch([rows.column(0).take(pa.array(text)), pa.array([terms[t] for t in term.tolist()], pa.binary()), pa.array(tf, pa.int64())],
                              names=["key", "term", "times"])


def _ints(values: np.ndarray, ends: np.ndarray, kind=pa.int32()) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _forward_batches(batches, vocabulary) -> Iterator[pa.RecordBatch]:
    number = {t: i for i, t in enumerate(vocabulary.value)}
    for rows, data, offsets in text_blocks(batches):
        n, text, term, tf = _counts(data, offsets, lambda found: np.array([number.get(t, -1) for t in found], np.int64))
        ends = np.searchsorted(text, np.arange(len(n) + 1))
        yield pa.record_batch([rows.column(0), pa.array(n, pa.int64()), _ints(term, ends), _ints(tf, ends)], names=["doc_id", "n", "terms", "tfs"])


def _stratum_batches(batches, block_docs: int) -> Iterator[pa.RecordBatch]:
    """Blocks of documents of equal m, which stand together: postings by (term, tf), and each term's greatest tf."""
    blocks = TaskContext.get().partitionId() << 40
    for batch in batches:
        if not batch.num_rows:
            continue
        m = batch.column(1).to_numpy()
        bounds, terms, tfs = batch.column(2).offsets.to_numpy().astype(np.int64), batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
        bounds = bounds - bounds[0]
        runs = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
        cuts = [c for a, b in zip(runs, np.append(runs[1:], len(m))) for c in range(a, b, block_docs)]
        out: dict[str, list] = {c: [] for c in ("block", "m", "docs", "terms", "top", "term", "tf", "size", "doc")}
        for a, b in zip(cuts, [*cuts[1:], len(m)]):
            x, y = bounds[a], bounds[b]
            term, tf = terms[x:y], tfs[x:y]
            doc = np.repeat(np.arange(b - a), np.diff(bounds[a:b + 1]))
            order = np.lexsort((doc, tf, term))
            term, tf, doc = term[order], tf[order], doc[order]
            first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])))
            last = np.append(first[1:], len(term))
            end_of_term = np.append(term[first][1:] != term[first][:-1], True)
            for name, value in (("block", blocks), ("m", m[a]), ("docs", batch.column(0).slice(a, b - a)), ("terms", term[first][end_of_term]),
                                ("top", tf[first][end_of_term]), ("term", term[first]), ("tf", tf[first]), ("size", last - first), ("doc", doc)):
                out[name].append(value)
            blocks += 1
        lists = [_ints(np.concatenate(out[c]), np.append(0, np.cumsum([len(v) for v in out[c]]))) for c in ("terms", "top", "term", "tf", "size", "doc")]
        docs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(v) for v in out["docs"]])), pa.int32()), pa.concat_arrays(out["docs"]))
        yield pa.record_batch([pa.array(out["block"], pa.int64()), pa.array(out["m"], pa.int64()), docs, *lists],
                              names=["block", "m", "docs", "terms", "top", "term", "tf", "size", "doc"])


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class QueryBlock:
    """Rows (query, term, weight), by query, of a bounded number of terms."""

    def __init__(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, n_terms: int):
        order = np.lexsort((term, query))
        self.term, self.weight, self.n_terms = term[order], weight[order], n_terms
        self.ends = np.searchsorted(query[order], np.arange(n + 1))

    def bounds(self, terms: np.ndarray, impacts: np.ndarray) -> np.ndarray:
        """For each query the sum of weight * impact."""
        of = np.zeros(self.n_terms, np.int64)
        of[terms] = impacts
        sums = np.append(0, np.cumsum(self.weight * of[self.term]))
        return sums[self.ends[1:]] - sums[self.ends[:-1]]

    def of(self, query: int) -> tuple[np.ndarray, np.ndarray]:
        rows = slice(self.ends[query], self.ends[query + 1])
        return self.term[rows], self.weight[rows]


def _bound_batches(batches, queries) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            terms, top = (batch.column(c)[row].values.to_numpy().astype(np.int64) for c in (2, 3))
            bound = queries.value.bounds(terms, impact(top, batch.column(1)[row].as_py()))
            some = np.flatnonzero(bound > 0)
            yield pa.record_batch([pa.array(some, pa.int32()), pa.array(np.full(len(some), batch.column(0)[row].as_py()), pa.int64()), pa.array(bound[some])],
                                  names=["query", "block", "bound"])


def block_scores(queries: QueryBlock, query: int, m: int, n_docs: int, term, tf, size, doc, impacts=None) -> np.ndarray:
    """The query's score of each document of a block."""
    asked, weight = queries.of(query)
    impacts = impact(tf, m) if impacts is None else impacts
    place = np.searchsorted(term, asked), np.searchsorted(term, asked, "right")
    groups = gather(place[0], place[1] - place[0])
    value = np.repeat(weight, place[1] - place[0]) * impacts[groups]
    at = gather((np.cumsum(size) - size)[groups], size[groups])
    value = np.repeat(value, size[groups])
    if int(value.max(initial=0)) * max(len(asked), 1) < _EXACT:
        return np.bincount(doc[at], value, n_docs).astype(np.int64)
    scores = np.zeros(n_docs, np.int64)
    np.add.at(scores, doc[at], value)
    return scores


def _score_batches(batches, queries, k: int) -> Iterator[pa.RecordBatch]:
    """The k best documents, of those that reach the query's least score, of each visit."""
    for batch in batches:
        column = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
        for row in range(batch.num_rows):
            term, tf, size, doc = (column[c][row].values.to_numpy().astype(np.int64) for c in ("term", "tf", "size", "doc"))
            docs, m = column["docs"][row].values, column["m"][row].as_py()
            distinct, code = np.unique(tf, return_inverse=True)
            impacts = impact(distinct, m)[code]
            ids = docs.fill_null(2 ** 63 - 1).to_numpy(zero_copy_only=False)
            found = [], [], []
            for visit in column["visits"][row].as_py():
                score = block_scores(queries.value, visit["query"], m, len(docs), term, tf, size, doc, impacts)
                good = np.flatnonzero(score >= max(visit["least"], 1))
                good = good[np.lexsort((ids[good], -score[good]))[:k]]
                found[0].append(np.full(len(good), visit["query"], np.int32)), found[1].append(good), found[2].append(score[good])
            query, at, score = (np.concatenate(x) for x in found)
            yield pa.record_batch([pa.array(query), docs.take(pa.array(at)), pa.array(score)], names=["query", "doc_id", "score"])


def index(docs: DataFrame, vocabulary, block_docs: int = BLOCK_DOCS) -> tuple[DataFrame, np.ndarray]:
    """Blocks of the strata of ``docs`` (doc_id long, text) for the broadcast list of terms, and each term's weight."""
    spark = docs.sparkSession
    forward = written(docs.mapInArrow(lambda b: _forward_batches(b, vocabulary), "doc_id long, n long, terms array<int>, tfs array<int>"), "forward")
    total = forward.where("n > 0").agg(F.count("*").alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    counts = forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    ratio = F.lit(2 * total["N"] + 2).cast("double") / (2 * F.col("df") + 1).cast("double")
    weights = np.zeros(len(vocabulary.value), np.int64)
    for r in counts.select("term", F.floor(1000 * F.log(ratio)).cast("long").alias("w")).collect():  # one row per asked term
        weights[r["term"]] = r["w"]
    m = F.expr(f"25 + (75 * n * {total['N']}L) div {max(total['L'], 1)}L")
    spread = (forward.where(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "tfs")
              .repartitionByRange("m", F.xxhash64("doc_id", "terms")).sortWithinPartitions("m"))
    lists = ", ".join(f"{c} array<int>" for c in ("terms", "top", "term", "tf", "size", "doc"))
    blocks = spread.mapInArrow(lambda b: _stratum_batches(b, block_docs), f"block long, m long, docs array<long>, {lists}")
    return written(blocks, "strata"), weights


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_block(blocks: DataFrame, queries, k: int, visits=FIRST_VISITS) -> DataFrame:
    """query, rank, doc_id, score for one broadcast block of queries."""
    bounds = written(blocks.select("block", "m", "terms", "top")
                     .mapInArrow(lambda b: _bound_batches(b, queries), "query int, block long, bound long"), "bounds")
    found, left = None, bounds.withColumn("least", F.lit(1).cast("long"))
    for first in (*visits, None):
        if first is None:
            chosen = left
        else:
            order = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
            chosen = left.withColumn("n", F.row_number().over(order)).where(F.col("n") <= first).drop("n")
        chosen = written(chosen, "visits")
        by_block = chosen.groupBy("block").agg(F.collect_list(F.struct("query", "least")).alias("visits"))
        scored = (blocks.drop("terms", "top").hint("shuffle_hash").join(by_block, "block")
                  .mapInArrow(lambda b: _score_batches(b, queries, k), "query int, doc_id long, score long"))
        found = written(_best(scored if found is None else scored.unionByName(found.drop("rank")), k), "found")
        if first is None:
            break
        least = found.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        left = (left.join(chosen.select("query", "block"), ["query", "block"], "left_anti").join(F.broadcast(least), "query", "left")
                .select("query", "block", "bound", F.greatest("least", F.coalesce("kth", F.lit(1))).alias("least")).where("bound >= least"))
        left = written(left, "left")
        if left.isEmpty():
            break
    return found


def search(docs: DataFrame, items: DataFrame, k: int = K, query_terms: int = QUERY_TERMS, block_docs: int = BLOCK_DOCS, visits=FIRST_VISITS) -> DataFrame:
    """The k rows of ``docs`` (doc_id, text) that score highest for each of ``items`` (item_id, text): item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = written(items.select("item_id", "text").distinct().withColumn("key", F.monotonically_increasing_id()), "items")
    terms = written(asked.select("key", "text").mapInArrow(_query_batches, "key long, term binary, times long"), "item-terms")
    n = -(-terms.count() // query_terms)
    out = None
    for part in range(n):
        rows = terms.where(F.pmod(F.xxhash64("key"), F.lit(n)) == part).toPandas()  # about query_terms rows
        term, vocabulary = pd.factorize(rows["term"], sort=True)
        query, keys = pd.factorize(rows["key"], sort=True)
        blocks, weights = index(docs, spark.sparkContext.broadcast(list(vocabulary)), block_docs)
        block = QueryBlock(query, term, rows["times"].to_numpy() * weights[term], len(keys), len(vocabulary))
        names = spark.createDataFrame(pd.DataFrame({"query": range(len(keys)), "key": keys}), "query int, key long")
        found = search_block(blocks, spark.sparkContext.broadcast(block), k, visits).join(F.broadcast(names), "query")
        out = found if out is None else out.unionByName(found)
    if out is None:
        kind = items.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out.join(asked.select("key", "item_id"), "key").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
