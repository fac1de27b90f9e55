"""Shared helpers: worker import path, cut lineage, byte-level views of Arrow text columns."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsense.session import shared_scratch
from tabsense.sources.tables import table

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Text bytes that one vectorised step inside a task works on.
BLOCK_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; Python workers are told where this package lies."""
    worker_path(spark)
    return table(spark, sf_dir, name)


def worker_path(spark: SparkSession) -> None:
    """Python workers inherit the folder of the package, in case the session was started elsewhere."""
    env = spark.sparkContext.environment
    if ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        env.setdefault("PYTHONPATH", ROOT)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the cluster's shared folder and read back: later jobs neither recompute it nor depend on an executor."""
    path = shared_scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_CACHES: dict[str, dict] = {}


def give_back() -> None:
    """Freed memory goes back to the machine: a worker lives on for later stages, and beside others on its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def worker_cache(name: str) -> dict:
    """The cache that this worker keeps between tasks.  It keeps one: asking for another empties those before it."""
    others = [k for k in _CACHES if k != name]
    for other in others:
        del _CACHES[other]
    if others:
        give_back()
    return _CACHES.setdefault(name, {})


def fold(doc_id, folds: int):
    """crc32 of the id's decimal text, modulo ``folds``; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text",
                limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of about ``limit`` text bytes each.  NULL texts have no bytes; a text is never split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
        raw = col.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(col):
            to = int(np.searchsorted(ends, ends[at] + limit, "right")) - 1
            to = min(max(to, at + 1), len(col))
            yield batch.slice(at, to - at), data[ends[at]:ends[to]], ends[at:to + 1] - ends[at]
            at = to
    give_back()


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes between words of letters and digits: ASCII ones that are neither; bytes of other characters belong to words.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def lowered(data: np.ndarray) -> np.ndarray:
    """A copy with A-Z, and nothing else, in lower case."""
    return data + ((data >= 65) & (data <= 90)) * np.uint8(32)


def binary_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges [start, end) as an Arrow array; ranges are disjoint and ascending."""
    if len(starts) and starts[0] == 0 and np.array_equal(starts[1:], ends[:-1]):
        offsets = np.append(starts, ends[-1]).astype(np.int64)
        data = np.ascontiguousarray(data)
        return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    sizes = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(starts),
                                 [None, pa.py_buffer(offsets), pa.py_buffer(data[gather(starts, sizes)])])


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of all ranges one after another."""
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(total)


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than ``space`` (ASCII white space): starts, ends, and the text each belongs to."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~space[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[(offsets < len(data))]
    first[inner] = solid[inner]
    starts = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    closing = offsets[1:][offsets[1:] > 0] - 1
    last[closing] = solid[closing]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def coded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Code of each range and the distinct ranges."""
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    d = binary_array(data, starts, ends).dictionary_encode()
    return d.indices.to_numpy().astype(np.int64), d.dictionary


def per_text(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``values`` over each text."""
    return np.bincount(owner, weights=values, minlength=n) if len(owner) else np.zeros(n)
