"""Exact ids of a public tokenizer from a worker's cache of spans.

A text is cut where ASCII white space follows a character that is certainly
not white space, and where an ASCII letter is followed by an ASCII sign or
digit.  No pre-token of the two patterns used here reaches over such a place
and none looks beyond it, so each span is encoded alone, by the tokenizers
library, and reused while it stays in the worker's bounded cache.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from tabsense.llm.common import SPACE, coded, gather, worker_cache

#: Spans kept by one worker; past it those used in fewer than two blocks go.
CACHE_SPANS = 400_000

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
SIGN = ~SPACE & ~LETTER
SIGN[128:] = False


def letter_ends(data: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Whether an ASCII letter ends just before each byte, which is one of ``sign``."""
    cut = np.zeros(len(data), bool)
    cut[1:] = LETTER[data[:-1]] & sign[data[1:]]
    return cut


def spaced_cuts(data: np.ndarray) -> np.ndarray:
    """Whether ASCII white space begins at each byte, after a character that is no white space at all."""
    space = SPACE[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = space[1:] & ~space[:-1]
    wide = np.flatnonzero(cut)
    wide = wide[data[wide - 1] >= 0x80]
    if len(wide):  # the last character might be white space beyond ASCII: leave those places whole
        two, three = data[wide - 2], data[np.maximum(wide - 3, 0)]
        odd = ((two == 0xC2) | (three == 0xE1) & (two == 0x9A) | (three == 0xE2) & ((two == 0x80) | (two == 0x81))
               | (three == 0xE3) & (two == 0x80))
        cut[wide[odd]] = False
    return cut


class SpanEncoder:
    """``spaced``: spans keep their leading white space (byte-level patterns); else white space carries no id
    and the tokenizer lower-cases, so spans of ASCII letters are looked up in lower case."""

    def __init__(self, path: str, spaced: bool, limit: int = CACHE_SPANS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.spaced, self.limit = spaced, limit
        self.sign = SIGN.copy()  # special strings stay whole
        for token in self.tokenizer.get_added_tokens_decoder().values():
            raw = np.frombuffer(token.content.encode(), np.uint8)
            self.sign[raw[letter_ends(raw, SIGN)]] = False
        self.ends = None  # ids that end a pre-token, where the vocabulary marks them
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        if suffix and not spaced:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
            for token, i in self.tokenizer.get_vocab().items():
                self.ends[i] = token.endswith(suffix)
        self.slot: dict[bytes, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.begin, self.size, self.uses = (np.zeros(1 << 14, np.int64) for _ in range(3))
        self.used = 0

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes that spans cover without a gap, the spans' starts among them, and where each text begins and the last ends."""
        if not len(data):
            return data, np.zeros(0, np.int64), offsets
        cut = letter_ends(data, self.sign)
        inner = offsets[offsets < len(data)]
        if self.spaced:
            cut |= spaced_cuts(data)
            cut[inner] = True
            return data, np.flatnonzero(cut), offsets
        solid = ~SPACE[data]
        cut[1:] |= ~solid[:-1]
        cut[inner] = True
        flat = data[solid]
        kept = np.append(0, np.cumsum(solid, dtype=np.int64))[offsets]
        # a text that begins with white space: its first solid byte follows some, so it is cut there
        starts = np.flatnonzero(cut[solid])
        pure = np.minimum.reduceat(LETTER[flat], starts) if len(starts) else np.zeros(0, bool)
        flat[(flat >= 65) & (flat <= 90) & np.repeat(pure, np.diff(np.append(starts, len(flat))))] += 32
        return flat, starts, kept

    def slots(self, distinct: pa.Array) -> np.ndarray:
        """Cache slot of each distinct span, after encoding those not met before."""
        keys = distinct.to_pylist()
        if len(self.slot) + len(keys) > self.limit and self.slot:
            self._purge()
        found = self.slot.get
        out = np.fromiter((found(k, -1) for k in keys), np.int64, len(keys))
        new = np.flatnonzero(out < 0)
        for at in range(0, len(new), 20_000):
            some = new[at:at + 20_000]
            out[some] = self._add([keys[i] for i in some])
        self.uses[out] += 1
        return out

    def _purge(self):
        keep = self.uses[:len(self.slot)] > 1
        if keep.sum() > self.limit // 2:
            keep[:] = False
        kept = [k for k, s in self.slot.items() if keep[s]]
        old = np.flatnonzero(keep)  # slots were given in this order
        ids = self.pool[gather(self.begin[old], self.size[old])]
        self.slot = dict(zip(kept, range(len(kept))))
        sizes = self.size[old].copy()
        self.size[:len(old)], self.begin[:len(old)], self.uses[:] = sizes, np.cumsum(sizes) - sizes, 0
        self.used = len(ids)
        self.pool[:len(ids)] = ids

    def _encoded(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all spans one after another, and how many each has."""
        if self.ends is not None:  # words of ASCII letters go in one text; ids that end a word tell them apart
            plain = [k for k in keys if k.isalpha()]
            if plain and len(plain) < len(keys):
                is_plain = np.fromiter((k.isalpha() for k in keys), bool, len(keys))
                parts = [self._encoded(plain), self._encoded([k for k in keys if not k.isalpha()])]
                order = np.append(np.flatnonzero(is_plain), np.flatnonzero(~is_plain))
                sizes = np.concatenate([n for _, n in parts])
                begin = np.cumsum(sizes) - sizes
                back = np.argsort(order)
                return np.concatenate([i for i, _ in parts])[gather(begin[back], sizes[back])], sizes[back]
            if plain:
                ids = np.concatenate([np.array(self.tokenizer.encode(b" ".join(keys[a:a + 1000]).decode(), add_special_tokens=False).ids, np.uint32)
                                      for a in range(0, len(keys), 1000)])
                ends = np.flatnonzero(self.ends[ids])
                if len(ends) == len(keys):
                    return ids, np.diff(np.append(-1, ends))
        ids = [x.ids for x in self.tokenizer.encode_batch_fast([k.decode() for k in keys], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum())), sizes

    def _add(self, keys: list[bytes]) -> np.ndarray:
        ids, sizes = self._encoded(keys)
        n, total = len(self.slot), len(ids)
        self.pool = _room(self.pool, self.used + total)
        self.begin, self.size, self.uses = (_room(a, n + len(keys)) for a in (self.begin, self.size, self.uses))
        self.pool[self.used:self.used + total] = ids
        self.begin[n:n + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.size[n:n + len(keys)] = sizes
        self.uses[n:n + len(keys)] = 0
        self.used += total
        self.slot.update(zip(keys, range(n, n + len(keys))))
        return np.arange(n, n + len(keys))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's ids begin and the last end)."""
        flat, starts, bounds = self.cut(data, offsets)
        codes, distinct = coded(flat, starts, np.append(starts[1:], len(flat))[:len(starts)])
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        at = self.slots(distinct)[codes]
        sizes = self.size[at]
        ids = self.pool[gather(self.begin[at], sizes)]
        before = np.append(0, np.cumsum(sizes))
        return ids, before[np.searchsorted(starts, bounds, "left")]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[:len(a)] = a
    return out


def encoder(path: str, spaced: bool) -> SpanEncoder:
    """This worker's encoder; it stays between tasks."""
    kept = worker_cache("spans")
    if (path, spaced) not in kept:
        kept[path, spaced] = SpanEncoder(path, spaced)
    return kept[path, spaced]
