"""Packing, chunked BPE and token counts against the tokenizers library itself."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

os.environ["TOKENIZERS_PARALLELISM"] = "false"
public_tokenizers = pytest.importorskip("public_tokenizers")
from llm_fixtures import SF_SMALL, _workers, odd_docs  # noqa: E402, F401
from tokenizers import Tokenizer  # noqa: E402

from tabsense.llm import chunked_bpe, packing, queries, token_counts  # noqa: E402
from tabsense.llm.spans import SpanEncoder  # noqa: E402

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TOKENIZER = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}
PIECES = ["a", "B", "Th", "é", "Σ", " ", "  ", "\n", "\t", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "|", "<", "1", "23", "!!", "#", "İ", "é",
          "　", " ", "\u0085", "漢字", "😀", "—", "\x1c", "the", " "]
texts = st.lists(st.lists(st.sampled_from(PIECES), max_size=40).map("".join), min_size=1, max_size=6)


def ids_of(path, text):
    return TOKENIZER[path].encode(text or "", add_special_tokens=False).ids


def arrays(some):
    raw = [(t or "").encode() for t in some]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw]))


ENCODERS = {p: SpanEncoder(p, p == BYTE, limit=300) for p in (BYTE, WORD)}  # a small cache: it is cleared again and again
CHUNKED = chunked_bpe.ChunkEncoder(BYTE, cache_ids=2000)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_spans_equal_the_library(some):
    for path, encoder in ENCODERS.items():
        ids, bounds = encoder.encode(*arrays(some))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [ids_of(path, t) for t in some]


@settings(max_examples=100, deadline=None)
@given(texts, st.integers(1, 12))
def test_chunk_joins_are_repaired_wherever_they_fall(some, every):
    data, offsets = arrays(some)
    real = chunked_bpe.chunk_starts
    cuts = np.unique(np.append(offsets[:-1][offsets[:-1] < len(data)], np.arange(0, len(data), every)))
    cuts = cuts[(data[cuts] & 0xC0) != 0x80] if len(data) else cuts
    chunked_bpe.chunk_starts = lambda d, o: cuts.astype(np.int64)
    try:
        ids, bounds = CHUNKED.encode(data, offsets)
    finally:
        chunked_bpe.chunk_starts = real
    for t, a, b in zip(some, bounds, bounds[1:]):
        assert ids[a:b].tolist() == ids_of(BYTE, t)
        assert CHUNKED.vocabulary.decode(ids[a:b]).tobytes().decode("utf-8", "replace") == TOKENIZER[BYTE].decode(ids_of(BYTE, t), skip_special_tokens=False)


def test_chunks_follow_the_content():
    rng = random.Random(1)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000))
    data, offsets = arrays(["prefix one " + passage, "another, longer prefix " + passage])
    starts = chunked_bpe.chunk_starts(data, offsets)
    chunks = [data[a:b].tobytes() for a, b in zip(starts, np.append(starts[1:], len(data)))]
    assert len(set(chunks)) < 0.6 * len(chunks) and b"".join(chunks) == data.tobytes()
    encoder = chunked_bpe.ChunkEncoder(BYTE)
    encoder.encode(data, offsets)
    assert encoder.encoded == len(set(chunks))


def test_chunk_length_is_bounded():
    data, offsets = arrays(["x" * 100_000, "é" * 50_000, ""])
    starts = chunked_bpe.chunk_starts(data, offsets)
    assert np.diff(np.append(starts, len(data))).max() <= chunked_bpe.MAX_CHUNK + 3
    assert not ((data[starts] & 0xC0) == 0x80).any()


def test_digests_and_round_trip(spark, odd_docs):
    rows = {(r.doc_id, r.n_tokens): r for r in chunked_bpe.digests(odd_docs, BYTE).collect()}
    source = odd_docs.collect()
    assert chunked_bpe.digests(odd_docs, BYTE).count() == len(source)
    for r in source:
        ids = ids_of(BYTE, r.text)
        got = rows[r.doc_id, len(ids)]
        assert got.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    encoded = chunked_bpe.encode(odd_docs, BYTE)
    back = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in chunked_bpe.decode(encoded, BYTE).collect())
    assert back == sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in source)
    broken = spark.createDataFrame([(1, [50000, 254]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [r.text for r in chunked_bpe.decode(broken, BYTE).orderBy("doc_id").collect()] == [TOKENIZER[BYTE].decode([50000, 254], skip_special_tokens=False), "", ""]


def test_token_counts(spark, odd_docs):
    for size in (0, 5, 1000):
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(odd_docs, BYTE, table_spans=size).collect())
        want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), n := len(ids_of(BYTE, r.text)), n > 512) for r in odd_docs.collect())
        assert got == want


def test_queries_on_whole_tables_equal_the_library(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    counts = {r.doc_id: r for r in queries.op7_token_counts(spark, SF_SMALL).collect()}
    digests = {r.doc_id: r for r in queries.op5_chunked_bpe(spark, SF_SMALL).collect()}
    assert len(counts) == len(digests) == len(docs)
    for d in docs:
        ids = ids_of(BYTE, d.text)
        assert counts[d.doc_id].n_tokens == digests[d.doc_id].n_tokens == len(ids)
        assert digests[d.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def check_pieces(pieces, docs):
    """Every id in exactly one piece with its checksum; sequences gapless, of a window or a power of two; steps of one token count."""
    by_doc, by_sequence, steps = defaultdict(list), defaultdict(list), defaultdict(int)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == {d.doc_id for d in docs}
    for d in docs:
        ids = np.array(ids_of(WORD, d.text) + [2], "<u4")
        at = 0
        for p in sorted(by_doc[d.doc_id], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096 and at & (at - 1) == 0 and {p.tier for p in own} == {at} and len({p.step_group for p in own}) == 1
        steps[own[0].step_group] += at
    assert sum(n != packing.STEP_TOKENS for n in steps.values()) <= 16  # the open groups of the tasks


def test_packing(spark, odd_docs):
    docs = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_pieces(packing.pack(docs, WORD).collect(), docs.collect())
    whole = packing.pack(odd_docs, WORD).collect()  # repeated and NULL ids: packed row by row
    assert sum(p.length for p in whole) == sum(len(ids_of(WORD, r.text)) + 1 for r in odd_docs.collect())
    assert packing.pack(odd_docs.where("false"), WORD).count() == 0


def test_packing_query(spark):
    check_pieces(queries.op1_hierarchical_packing(spark, SF_SMALL).collect(), spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10_000), max_size=40))
def test_packer_fills_every_window(lengths):
    packer = packing.Packer()
    for i, n in enumerate(lengths):
        packer.add(i, np.arange(n, dtype="<u4"))
        if i % 7 == 6:
            packer.pack()
    packer.close()
    total = defaultdict(int)
    for doc, start, length, *_ in packer.rows:
        total[doc] += length
    assert dict(total) == dict(enumerate(lengths))
    sizes = defaultdict(int)
    for row in packer.rows:
        sizes[row[5]] += row[2]
    assert all(n & (n - 1) == 0 and n <= 4096 for n in sizes.values())


def test_packing_rejects_other_tiers(spark, odd_docs):
    with pytest.raises(ValueError):
        packing.pack(odd_docs, WORD, tiers=(1000, 4096))
