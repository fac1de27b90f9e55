"""Dense features of whole texts, computed for a block of texts at a time in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tabsense.llm.common import coded, per_text, words

UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LOWER = np.zeros(256, bool)
LOWER[97:123] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".,;:?"]] = True
MARK = np.zeros(256, bool)
MARK[[i for i in range(33, 127) if not (chr(i).isalnum() or chr(i) in ".,;:?'\"-()")]] = True

#: Text bytes worked on at a time: some twenty numbers of four or eight bytes are held for each.
FEATURE_BYTES = 2 << 20

NAMES = ("log_bytes", "log_words", "upper", "digits", "stops", "marks", "beyond_ascii", "lines", "word_length", "word_length_sd",
         "distinct_words", "word_entropy", "same_as_last", "top_word", "distinct_shingles", "marked_words", "shouted_words", "signless_words",
         "long_words", "title_words", "mark_words", "line_ends", "short_lines", "no_words")


def dense(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """texts x NAMES; all finite, an empty text has zeros and no_words = 1."""
    n = len(offsets) - 1
    out = np.zeros((n, len(NAMES)))
    out[:, 14] = 1.0  # nothing is repeated
    size = np.diff(offsets).astype(float)
    starts, ends, owner = words(data, offsets)
    count = per_text(np.ones(len(starts)), owner, n)
    some, bytes_, words_ = count > 0, np.maximum(size, 1), np.maximum(count, 1)

    def bytes_of(mask):
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(mask[data], out=total[1:])
        return total, np.diff(total[offsets]) / bytes_

    upper, f_upper = bytes_of(UPPER)
    digit, f_digit = bytes_of(DIGIT)
    mark, f_mark = bytes_of(MARK)
    lower, _ = bytes_of(LOWER)
    stop, f_stop = bytes_of(STOP)
    wide, f_wide = bytes_of(np.arange(256) >= 0x80)
    newline, f_line = bytes_of(np.arange(256) == 10)
    out[:, :8] = np.stack([np.log1p(size), np.log1p(count), f_upper, f_digit, f_stop, f_mark, f_wide, f_line], 1)
    if len(starts):
        codes, distinct = coded(data, starts, ends)
        length = (ends - starts).astype(float)
        mean = per_text(length, owner, n) / words_
        out[:, 8], out[:, 9] = mean, np.sqrt(np.maximum(per_text(length * length, owner, n) / words_ - mean * mean, 0))
        key, times = np.unique(owner * np.int64(len(distinct)) + codes, return_counts=True)
        of = key // len(distinct)
        out[:, 10] = per_text(np.ones(len(key)), of, n) / words_
        share = times / words_[of]
        out[:, 11] = -per_text(share * np.log(share), of, n)
        top = np.zeros(n)
        np.maximum.at(top, of, share)
        out[:, 13] = top
        again = np.append(False, (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1]))
        out[:, 12] = per_text(again, owner, n) / words_
        mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
        h = np.zeros(len(codes), np.uint64)
        for k in range(min(5, len(codes))):
            h[:len(codes) - k] = h[:len(codes) - k] * np.uint64(0x100000001B3) ^ mixed[k:]
        whole = np.append(owner[4:] == owner[:-4], np.zeros(min(4, len(owner)), bool)) if len(owner) > 4 else np.zeros(len(owner), bool)
        mine = h[whole] ^ (owner[whole].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        _, first = np.unique(mine, return_index=True)
        grams = per_text(np.ones(int(whole.sum())), owner[whole], n)
        out[:, 14] = np.where(grams > 0, per_text(np.ones(len(first)), owner[whole][first], n) / np.maximum(grams, 1), 1.0)
        inside = lambda total: total[ends] - total[starts]
        marks, ups, lows, digits, wides = inside(mark), inside(upper), inside(lower), inside(digit), inside(wide)
        out[:, 15] = per_text((marks >= 2) & (ups + lows + wides > 0), owner, n) / words_
        out[:, 16] = per_text((ups >= 2) & (lows == 0), owner, n) / words_
        out[:, 17] = per_text((marks + inside(stop)) == 0, owner, n) / words_
        out[:, 18] = per_text(length > 20, owner, n) / words_
        out[:, 19] = per_text(UPPER[data[starts]] & (lows > 0), owner, n) / words_
        out[:, 20] = per_text((marks > 0) & (ups + lows + digits + wides == 0), owner, n) / words_
        after = np.minimum(ends, len(data) - 1)
        out[:, 21] = per_text(STOP[data[ends - 1]] & ((data[after] == 10) | (ends == len(data))), owner, n) / words_
    out[:, 22] = np.diff(newline[offsets]) / words_
    out[:, 23] = ~some
    return out


def list_array(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as an Arrow column of array<double>."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
