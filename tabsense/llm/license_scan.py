"""License scan: one Aho-Corasick pass finds notice phrases and identifier tags; a shunting-yard parser evaluates the
licence expression after a tag.

Words are runs of ASCII letters and digits and of all other characters, A-Z in lower case.  A phrase or tag is found
wherever its words stand consecutively, whatever stands between them.  After a tag (``SPDX-License-Identifier:``,
``licensed under``, ...) the longest well-formed expression of licence ids, ``AND``, ``OR``, ``WITH`` and parentheses
on the same line is parsed.  Its value is what it obliges to: each id has a level (0 permissive, 1 weak copyleft,
2 copyleft, 3 restricted), ``AND`` takes the greater, ``OR`` the smaller (the licensee may choose), and an exception
after ``WITH`` lowers a copyleft by one.

A text's work is one pass of numpy and one of the automaton, in blocks of some megabytes; nothing is shuffled.

Defined results: a NULL or empty text has no words and no finds; repeated rows are scanned each; a NULL id is passed
on; other columns are ignored; overlapping phrases all count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsense.llm.common import NOT_ALNUM, gather, lowered, text_blocks, words

#: The base phrases and their labels (fixed values).
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notices and their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
#: Words of a tag, and what must stand between it and the expression.
TAGS = {
    "spdx license identifier": rb"[ \t]*[:=][ \t]*[\"']?",
    "license expression": rb"[\"']?[ \t]*[:=][ \t]*[\"']?",
    "licensed under": rb"[ \t]+(?:the[ \t]+)?",
    "released under": rb"[ \t]+(?:the[ \t]+)?",
}
#: Level of obligation by the id's first part (fixed values); other ids are restricted, as nothing is known of them.
LEVELS = {
    "mit": 0, "isc": 0, "bsd": 0, "apache": 0, "zlib": 0, "unlicense": 0, "cc0": 0, "0bsd": 0, "wtfpl": 0, "psf": 0,
    "lgpl": 1, "mpl": 1, "epl": 1, "cddl": 1, "ofl": 1, "artistic": 1,
    "gpl": 2, "agpl": 2, "eupl": 2, "osl": 2,
    "cc": 3, "licenseref": 3, "bsl": 3, "sspl": 3,
}
TERMS = ("permissive", "weak-copyleft", "copyleft", "restricted")
#: What one kind of find says of the text being under a licence; independent finds add up as chances do.
WEIGHTS = {"base": 0.6, "notice": 0.6, "expression": 0.9}
BLOCK_BYTES = 2 << 20

_TOKEN = re.compile(rb"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+-]*)")
_BINDING = {"or": 1, "and": 2, "with": 3}
FIND = pa.struct([("kind", pa.string()), ("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("expression", pa.string())])
FIND_DDL = "struct<kind string, label string, first_word long, n_words long, expression string>"


def _is_id(token: str) -> bool:
    """A known licence's name, alone or with parts, or an unknown name with a version."""
    family, *parts = token.split("-")
    known = family.rstrip("+") in LEVELS and (parts or family not in ("cc", "licenseref", "artistic"))
    return bool(known or parts and any(c.isdigit() for c in token))


def tokens(data: bytes, at: int, stop: int) -> tuple[list[str], int]:
    """The longest well-formed expression from ``at``, before ``stop``, as lower-case tokens (none: empty), and where it ends."""
    found, good, end, depth, operand = [], 0, at, 0, True
    while m := _TOKEN.match(data, at, stop):
        raw = m.group(1).decode("ascii").lower()
        token = raw.rstrip(".-")  # a full stop ends the expression with this token
        if operand and token == "(":
            depth += 1
        elif operand and (_is_id(token) or found[-1:] == ["with"] and token not in (")", *_BINDING)):
            operand = False
        elif not operand and token == ")" and depth:
            depth -= 1
        elif not operand and raw in _BINDING:
            operand = True
        else:
            break
        found.append(token)
        at = m.end() - len(raw) + len(token)
        if not operand and not depth:
            good, end = len(found), at
        if token != raw:
            break
    return found[:good], end


def postfix(found: list[str]) -> list[str]:
    """The tokens in postfix order: ``with`` binds before ``and``, that before ``or``."""
    out, stack = [], []
    for token in found:
        if token == "(":
            stack.append(token)
        elif token == ")":
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif token in _BINDING:
            while stack and _BINDING.get(stack[-1], 0) >= _BINDING[token]:
                out.append(stack.pop())
            stack.append(token)
        else:
            out.append(token)
    return out + stack[::-1]


def evaluate(found: list[str]) -> tuple[int, list[str]]:
    """The level that an expression obliges to, and its ids' labels."""
    stack, labels = [], []
    for token in postfix(found):
        if token == "with":
            stack.pop()
            level = stack.pop()
            stack.append((level[0] - 1 if level[0] in (1, 2) else level[0], level[1]))
        elif token in _BINDING:
            b, a = stack.pop(), stack.pop()
            stack.append(((max if token == "and" else min)(a[0], b[0]), a[1] + b[1]))
        else:
            part = token.split("-")
            family = part[0].rstrip("+")
            # what stands after "with" is an exception's name: popped, never a label
            stack.append((LEVELS.get(family, 3), ["-".join(x for x in part if x.isalpha()) if family == "cc" else family]))
    level, labels = stack.pop()
    return level, sorted(set(labels))


def _automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    kinds: dict[str, list] = {}
    for kind, table in (("base", BASE), ("notice", NOTICES), ("tag", {k: re.compile(v) for k, v in TAGS.items()})):
        for phrase, value in table.items():
            kinds.setdefault(phrase, []).append((kind, value))
    for phrase, what in kinds.items():
        made.add_word(phrase, (len(phrase), phrase.count(" ") + 1, what))
    made.make_automaton()
    return made


def finds(automaton, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[dict]]]:
    """Words of each text, and its finds in order of their first word."""
    n = len(offsets) - 1
    starts, ends, owner = words(data, offsets, NOT_ALNUM)
    out: list[list[dict]] = [[] for _ in range(n)]
    if not len(starts):
        return np.zeros(n, np.int64), out
    before = np.searchsorted(owner, np.arange(n))
    sizes = ends - starts
    at = np.cumsum(sizes + 1) - sizes - 1  # of each word in the stream of words with one space after each
    stream = np.full(int(at[-1] + sizes[-1] + 1), 32, np.uint8)
    stream[gather(at, sizes)] = lowered(data)[gather(starts, sizes)]
    raw = None
    for last, (length, n_words, what) in automaton.iter(stream.tobytes().decode("latin-1")):
        begin = last - length + 1
        w = int(np.searchsorted(at, begin))
        to = w + n_words - 1
        if w == len(at) or at[w] != begin or at[to] + sizes[to] != last + 1 or owner[w] != owner[to]:
            continue  # inside a longer word, or over the end of a text
        text = int(owner[w])
        first = w - int(before[text])
        for kind, value in what:
            if kind != "tag":
                out[text].append(dict(kind=kind, label=value, first_word=first, n_words=n_words, expression=None))
                continue
            raw = data.tobytes() if raw is None else raw
            m = value.match(raw, int(ends[to]), int(offsets[text + 1]))
            found, end = tokens(raw, m.end(), int(offsets[text + 1])) if m else ([], 0)
            if found:
                level, labels = evaluate(found)
                for label in [*labels, f"terms:{TERMS[level]}"]:
                    out[text].append(dict(kind="expression", label=label, first_word=first, n_words=n_words, expression=raw[m.end():end].decode("ascii").strip()))
    for row in out:
        row.sort(key=lambda f: (f["first_word"], f["kind"], f["label"]))
    return np.bincount(owner, minlength=n), out


def _scan_batches(batches) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for rows, data, offsets in text_blocks(batches, limit=BLOCK_BYTES):
        counts, found = finds(automaton, data, offsets)
        yield pa.record_batch([rows.column(0), pa.array(counts, pa.int64()), pa.array(found, pa.list_(FIND))], names=["doc_id", "n_words", "finds"])


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, finds (kind, label, first_word, n_words, expression)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan_batches, f"doc_id {kind}, n_words long, finds array<{FIND_DDL}>")


def labels_of(found: Column) -> Column:
    """The distinct labels of an array of finds, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda f: f["label"]))), ",")


def evidence(found: Column) -> Column:
    """0 without finds, towards 1 with each further kind and label found."""
    distinct = F.array_distinct(F.transform(found, lambda f: F.struct(f["kind"], f["label"])))
    weight = lambda kind: F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])[kind]
    return F.lit(1.0) - F.aggregate(distinct, F.lit(1.0), lambda left, f: left * (F.lit(1.0) - weight(f["kind"])))
