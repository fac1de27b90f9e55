"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

A Gear rolling hash over the last 32 bytes places chunk cuts, so equal
passages give equal chunks in whatever document they stand.  The chunks that
repeat most are found by summing bounded per-task summaries, encoded once and
broadcast (``table_bytes`` bounds them); any other chunk is encoded once per
worker while it stays in the worker's cache.  A cut may fall inside a
pre-token.  Each join is then repaired: the text around it is encoded anew,
in a window that widens until both its edges are token ends of the chunk
encodings and places that no pre-token reaches over.

Defined results: a NULL text is read as the empty text (0 ids, digests of
nothing); equal and NULL ids are encoded row by row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsense.llm.common import coded, gather, text_blocks
from tabsense.llm.spans import encoder

#: A cut where the rolling hash has these bits clear: 1,024 bytes apart on average, 16 KB at most.
CUT_MASK, MAX_CHUNK = np.uint32(0xFFC00000), 16_384
#: Bound of the broadcast chunks, and of a worker's cache of ids (4 bytes each).
TABLE_BYTES, CACHE_IDS = 8 << 20, 8 << 20
SUMMARY_CHUNKS = 512

_GEAR = np.random.default_rng(20240611).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash at each byte: the sum of G[byte] << age over the last 32 bytes, by doubling."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    return h


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the chunks, at characters' first bytes; chunks cover all bytes and stay within their text."""
    if not len(data):
        return np.zeros(0, np.int64)
    cut = np.zeros(len(data), bool)
    cut[1:] = (gear(data) & CUT_MASK)[:-1] == 0
    inner = offsets[offsets < len(data)]
    cut[inner] = True
    at = np.flatnonzero(cut)
    size = np.diff(np.append(at, len(data)))
    if (size > MAX_CHUNK).any():
        extra = (size - 1) // MAX_CHUNK
        at = at.repeat(extra + 1) + MAX_CHUNK * (np.arange((extra + 1).sum()) - np.repeat(np.cumsum(extra + 1) - extra - 1, extra + 1))
    for _ in range(3):  # not inside a character
        at = np.where((data[np.minimum(at, len(data) - 1)] & 0xC0) == 0x80, at + 1, at)
    return np.unique(at[at < len(data)])


class Vocabulary:
    """Bytes of each id of a byte-level vocabulary."""

    def __init__(self, tokenizer):
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        tokens = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
        for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
            tokens[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.data[gather(self.start[ids], self.size[ids])]


class ChunkEncoder:
    def __init__(self, path: str, table: dict[bytes, np.ndarray] | None = None, cache_ids: int = CACHE_IDS):
        self.spans = encoder(path, spaced=True)
        self.vocabulary = Vocabulary(self.spans.tokenizer)
        self.table, self.cache, self.cached, self.limit = table or {}, {}, 0, cache_ids
        self.encoded = self.reused = 0

    def _chunks(self, distinct: pa.Array) -> list[np.ndarray]:
        """Ids of each distinct chunk; those neither broadcast nor cached are encoded now."""
        keys = distinct.to_pylist()
        out = [self.table.get(k) if k in self.table else self.cache.get(k) for k in keys]
        new = [i for i, x in enumerate(out) if x is None]
        self.encoded += len(new)
        self.reused += len(out) - len(new)
        if new:
            some = distinct.take(pa.array(new)).to_pylist()
            data = np.frombuffer(b"".join(some), np.uint8)
            offsets = np.append(0, np.cumsum([len(x) for x in some]))
            ids, bounds = self.spans.encode(data, offsets)
            if self.cached + len(ids) > self.limit:
                self.cache, self.cached = {}, 0
            for i, key, a, b in zip(new, some, bounds[:-1], bounds[1:]):
                out[i] = self.cache[key] = ids[a:b].copy()
            self.cached += len(ids)
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's ids begin and the last end)."""
        starts = chunk_starts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        codes, distinct = coded(data, starts, np.append(starts[1:], len(data)))
        parts = self._chunks(distinct)
        ids = np.concatenate([parts[c] for c in codes.tolist()])
        size = self.vocabulary.size
        begin = np.cumsum(size[ids]) - size[ids]  # byte at which each id begins
        ids, begin = self._repair(data, offsets, starts, ids, begin)
        return ids, np.searchsorted(begin, offsets, "left")

    def _repair(self, data, offsets, starts, ids, begin):
        _, safe, _ = self.spans.cut(data, offsets)
        edges = np.append(safe, len(data))
        joins = starts[~np.isin(starts, safe, assume_unique=True)]
        if not len(joins):
            return ids, begin
        lo = np.searchsorted(edges, joins, "right") - 1
        hi = lo + 1
        marks = np.append(begin, len(data))
        while True:  # widen the windows whose edges are inside an id of the chunk encodings
            bad_lo, bad_hi = ~np.isin(edges[lo], marks), ~np.isin(edges[hi], marks)
            if not (bad_lo.any() or bad_hi.any()):
                break
            lo, hi = lo - bad_lo, hi + bad_hi
        first = np.append(True, lo[1:] >= np.maximum.accumulate(hi)[:-1])  # overlapping windows become one
        left, right = edges[lo[first]], edges[np.maximum.reduceat(hi, np.flatnonzero(first))]
        window = np.searchsorted(left, begin, "right") - 1
        keep = (window < 0) | (begin >= right[np.maximum(window, 0)])
        codes, distinct = coded(data, left, right)
        slot = self.spans.slots(distinct)[codes]
        n = self.spans.size[slot]
        new = self.spans.pool[gather(self.spans.begin[slot], n)]
        kept_ids, kept_begin = ids[keep], begin[keep]
        at = np.repeat(np.searchsorted(kept_begin, left, "left"), n)
        size = self.vocabulary.size[new]
        within = np.cumsum(size) - size
        head = np.append(0, np.cumsum(n))[:-1]
        new_begin = np.repeat(left, n) + within - np.repeat(within[np.minimum(head, len(within) - 1)], n)
        return np.insert(kept_ids, at, new), np.insert(kept_begin, at, new_begin)


def summary_batches(batches: Iterator[pa.RecordBatch], summary: int) -> Iterator[pa.RecordBatch]:
    """The chunks that repeat most, by bytes saved, in one task's rows."""
    seen: dict[bytes, int] = {}
    rank = lambda x: (-len(x[0]) * x[1], x[0])
    for _, data, offsets in text_blocks(batches):
        starts = chunk_starts(data, offsets)
        codes, distinct = coded(data, starts, np.append(starts[1:], len(data))[:len(starts)])
        n = np.bincount(codes, minlength=len(distinct))
        top = np.flatnonzero(n > 1)
        for k, v in zip(distinct.take(pa.array(top)).to_pylist(), n[top].tolist()):
            seen[k] = seen.get(k, 0) + v
        if len(seen) > 4 * summary:
            seen = dict(sorted(seen.items(), key=rank)[:2 * summary])
    best = sorted(seen.items(), key=rank)[:summary]
    yield pa.record_batch([pa.array([k for k, _ in best], pa.binary()), pa.array([v for _, v in best], pa.int64())], names=["chunk", "n"])


def shared_chunks(docs: DataFrame, tokenizer: str, table_bytes: int = TABLE_BYTES, summary: int = SUMMARY_CHUNKS) -> dict[bytes, np.ndarray]:
    """Ids of the chunks that repeat most over all rows, each encoded once; at most ``table_bytes`` of text."""
    def encode(batches):
        enc = ChunkEncoder(tokenizer)
        for batch in batches:
            ids = [x.astype("<u4").tobytes() for x in enc._chunks(batch.column(0).cast(pa.large_binary()))]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary())], names=["chunk", "ids"])

    found = (docs.select("text").mapInArrow(lambda b: summary_batches(b, summary), "chunk binary, n long")
             .groupBy("chunk").agg(F.sum("n").alias("n"))
             .orderBy(F.desc(F.length("chunk") * F.col("n")), "chunk").limit(table_bytes // 1024)
             .select("chunk").mapInArrow(encode, "chunk binary, ids binary").collect())
    table, used = {}, 0
    for row in found:
        used += len(row.chunk)
        if used <= table_bytes:
            table[bytes(row.chunk)] = np.frombuffer(row.ids, "<u4")
    return table


def digest_batches(batches: Iterator[pa.RecordBatch], path: str, table) -> Iterator[pa.RecordBatch]:
    enc = ChunkEncoder(path, table.value)
    for rows, data, offsets in text_blocks(batches):
        ids, bounds = enc.encode(data, offsets)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own = ids[a:b].astype("<u4")
            text = enc.vocabulary.decode(own).tobytes().decode("utf-8", "replace")
            out.append((b - a, hashlib.sha256(own.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        n, sha, back = zip(*out)
        yield pa.record_batch([rows.column(0), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)],
                              names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, table) -> Iterator[pa.RecordBatch]:
    enc = ChunkEncoder(path, table.value)
    for rows, data, offsets in text_blocks(batches):
        ids, bounds = enc.encode(data, offsets)
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
        yield pa.record_batch([rows.column(0), lists], names=["doc_id", "ids"])


def decode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    vocabulary = Vocabulary(encoder(path, spaced=True).tokenizer)
    for rows in batches:
        lists = [np.asarray(x if x is not None else [], np.int64) for x in rows.column(1).to_pylist()]
        texts = [vocabulary.decode(x).tobytes().decode("utf-8", "replace") for x in lists]
        yield pa.record_batch([rows.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and the list of ids of every row's whole text."""
    table = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, tokenizer))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda b: encode_batches(b, tokenizer, table), "doc_id long, ids array<int>")


def decode(ids: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and the text of every row's ids; NULL ids give the empty text, bytes that are no UTF-8 become U+FFFD."""
    return ids.select(F.col("doc_id").cast("long"), "ids").mapInArrow(lambda b: decode_batches(b, tokenizer), "doc_id long, text string")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode and decode every row's whole text: number of ids and SHA-256 of the ids and of the decoded text."""
    table = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, tokenizer))
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lambda b: digest_batches(b, tokenizer, table), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
