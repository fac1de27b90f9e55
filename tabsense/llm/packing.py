"""Hierarchical multi-length packing.

Each task tokenizes its rows and packs them as they come, so no row is
shuffled.  A document of a whole window or more gives full windows first.
What is left is routed to the smallest context-size tier that holds it; the
longest leftover opens a window of its tier, the gap takes the longest pieces
that fit, from shorter tiers, and the last bit of it the head of a piece that
is cut.  Only a window still open carries over to the next block; the task's
very last one is split into lengths that are powers of two.  So no sequence
needs padding.  Sequences are dealt to step groups of one equal token count.

Defined results: a NULL or empty text is one end id; rows with equal or NULL
doc_id are packed row by row; other columns are ignored; no rows, no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tabsense.llm.common import text_blocks
from tabsense.llm.spans import encoder

WINDOW = 4096
TIERS = (512, 1024, 2048, 4096)
#: Tokens of one step group: eight windows.
STEP_TOKENS = 8 * WINDOW

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "tier int, step_group long")
_ARROW = pa.schema([(n, pa.int32() if t == "int" else pa.int64()) for n, t in (x.split() for x in SCHEMA.split(", "))])


class Packer:
    """One task's open pieces and counters.  A piece is (length, order, row, start)."""

    def __init__(self, tiers=TIERS, step_tokens: int = STEP_TOKENS, base: int = 0):
        self.tiers, self.window, self.step_tokens, self.base = sorted(tiers), max(tiers), step_tokens, base
        self.pieces: list[tuple[int, int, tuple, int]] = []
        self.order = self.sequences = self.groups = 0
        self.room: list[tuple[int, int]] = []  # (tokens left, step group)
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray):
        row, at = (doc_id, ids), 0
        while len(ids) - at >= self.window:
            self._emit([(self.window, 0, row, at)], self.window)
            at += self.window
        if at < len(ids):
            self._put(len(ids) - at, row, at)

    def _put(self, length: int, row: tuple, start: int):
        self.order += 1
        insort(self.pieces, (length, self.order, row, start), key=lambda p: p[:2])

    def pack(self):
        """Fill windows while pieces last; the one that stays open goes back."""
        while self.pieces:
            first = self.pieces.pop()
            tier = next(t for t in self.tiers if t >= first[0])
            got, gap = [first], tier - first[0]
            while gap and self.pieces:
                k = bisect_right(self.pieces, gap, key=lambda p: p[0])
                piece = self.pieces.pop(k - 1 if k else 0)
                if piece[0] > gap:  # nothing short enough: the shortest one is cut
                    self._put(piece[0] - gap, piece[2], piece[3] + gap)
                    piece = (gap, piece[1], piece[2], piece[3])
                got.append(piece)
                gap -= piece[0]
            if gap:
                for p in got:
                    self._put(p[0], p[2], p[3])
                return
            self._emit(got, tier)

    def close(self):
        """The last open pieces, cut into sequences whose lengths are powers of two."""
        self.pack()
        left, self.pieces = self.pieces[::-1], []
        while left:
            size = 1 << (sum(p[0] for p in left).bit_length() - 1)
            got, gap = [], size
            while gap:
                length, order, row, start = left.pop(0)
                take = min(length, gap)
                got.append((take, order, row, start))
                gap -= take
                if take < length:
                    left.insert(0, (length - take, order, row, start + take))
            self._emit(got, size)

    def _emit(self, pieces: list, size: int):
        sequence, offset = self.base + self.sequences, 0
        self.sequences += 1
        group = self._group(size)
        for length, _, (doc_id, ids), start in pieces:
            crc = zlib.crc32(ids[start:start + length].tobytes())
            self.rows.append((doc_id, start, length, crc, len(ids), sequence, offset, size, group))
            offset += length

    def _group(self, size: int) -> int:
        """The fullest step group that still has room: all but the last few end with the same number of tokens."""
        fits = [x for x in self.room if x[0] >= size]
        if fits:
            left, group = min(fits)
            self.room.remove((left, group))
        else:
            left, group = self.step_tokens, self.base + self.groups
            self.groups += 1
        if left > size:
            self.room.append((left - size, group))
        return group

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        cols = list(zip(*rows)) or [()] * len(_ARROW)
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)


def pack_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int, tiers, step_tokens: int) -> Iterator[pa.RecordBatch]:
    packer = Packer(tiers, step_tokens, TaskContext.get().partitionId() << 36)
    enc = encoder(path, spaced=False)
    for rows, data, offsets in text_blocks(batches):
        ids, bounds = enc.encode(data, offsets)
        for i, doc_id in enumerate(rows.column(0).to_pylist()):
            packer.add(doc_id, np.append(ids[bounds[i]:bounds[i + 1]], np.uint32(end_id)).astype("<u4"))
        packer.pack()
        yield packer.taken()
    packer.close()
    yield packer.taken()


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, tiers=TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text): see SCHEMA.  ``tier`` is the sequence's length."""
    if any(t & (t - 1) for t in tiers) or step_tokens % max(tiers):
        raise ValueError("tiers are powers of two, step_tokens a multiple of the largest")
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: pack_batches(batches, tokenizer, end_id, tiers, step_tokens), SCHEMA)
