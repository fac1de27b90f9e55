"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the lengths of the most frequent spans (a
pre-token with what the pattern may join to it, see ``spans``).  Every task
summarises its own rows to at most ``summary`` spans with counts; only these
summaries are summed, so no pre-token is shuffled.  Tier two, for spans not in
the table, is the worker's cache in front of the tokenizers library.  Both
tiers hold exact lengths: they decide the speed, never the count.

Defined results: NULL and empty texts have 0 bytes and 0 tokens; repeated or
NULL ids are counted row by row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.llm.common import coded, text_blocks
from tabsense.llm.spans import encoder

#: Rows and bytes per row of the broadcast table: at most 16,384 * 48 bytes.
TABLE_SPANS, TABLE_SPAN_BYTES = 16_384, 48
#: Spans that one task's summary keeps.
SUMMARY_SPANS = 4_096


def frequent_batches(batches: Iterator[pa.RecordBatch], path: str, summary: int) -> Iterator[pa.RecordBatch]:
    """A task's most frequent short spans (a lossy count with 8 * ``summary`` counters)."""
    enc, seen = encoder(path, spaced=True), {}
    for _, data, offsets in text_blocks(batches):
        _, starts, _ = enc.cut(data, offsets)
        codes, distinct = coded(data, starts, np.append(starts[1:], len(data))[:len(starts)])
        n = np.bincount(codes, minlength=len(distinct))
        top = np.flatnonzero((n > 1) & (pc.binary_length(distinct).to_numpy(zero_copy_only=False) <= TABLE_SPAN_BYTES))
        top = top[np.argsort(-n[top], kind="stable")[:8 * summary]]
        for k, v in zip(distinct.take(pa.array(top)).to_pylist(), n[top].tolist()):
            seen[k] = seen.get(k, 0) + v
        if len(seen) > 8 * summary:
            seen = dict(sorted(seen.items(), key=lambda x: -x[1])[:4 * summary])
    best = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:summary]
    yield pa.record_batch([pa.array([k for k, _ in best], pa.binary()), pa.array([v for _, v in best], pa.int64())], names=["span", "n"])


def frequent_spans(docs: DataFrame, tokenizer: str, size: int = TABLE_SPANS, summary: int = SUMMARY_SPANS) -> list[bytes]:
    """The at most ``size`` spans that lead the tasks' summaries."""
    rows = (docs.select("text").mapInArrow(lambda b: frequent_batches(b, tokenizer, summary), "span binary, n long")
            .groupBy("span").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "span").limit(size).collect())
    return [bytes(r.span) for r in rows]


def count_batches(batches: Iterator[pa.RecordBatch], path: str, table, max_tokens: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path, spaced=True)
    spans, lengths = table.value
    known = pa.array(spans, pa.large_binary())
    lengths = np.append(lengths, 0)
    for rows, data, offsets in text_blocks(batches):
        _, starts, _ = enc.cut(data, offsets)
        codes, distinct = coded(data, starts, np.append(starts[1:], len(data))[:len(starts)])
        hit = pc.index_in(distinct, value_set=known).fill_null(len(spans)).to_numpy(zero_copy_only=False)
        size = lengths[hit].astype(np.int64)
        missed = np.flatnonzero(hit == len(spans))
        if len(missed):
            at = enc.slots(distinct.take(pa.array(missed)))
            size[missed] = enc.size[at]
        before = np.append(0, np.cumsum(size[codes]))[np.searchsorted(starts, offsets, "left")] if len(codes) else np.zeros(len(offsets), np.int64)
        n = np.diff(before)
        yield pa.record_batch([rows.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(n, pa.int64()), pa.array(n > max_tokens)],
                              names=["doc_id", "n_bytes", "n_tokens", "over_limit"])


def count_tokens(docs: DataFrame, tokenizer: str, max_tokens: int = 512, table_spans: int = TABLE_SPANS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit."""
    spans = frequent_spans(docs, tokenizer, table_spans)
    enc = encoder(tokenizer, spaced=True)
    at = enc.slots(pa.array(spans, pa.large_binary()))
    lengths = enc.size[at].astype(np.int32)
    table = docs.sparkSession.sparkContext.broadcast((spans, lengths))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lambda b: count_batches(b, tokenizer, table, max_tokens),
        "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
