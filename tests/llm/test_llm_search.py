"""Length-stratified search against a plain loop."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from llm_fixtures import ODD_TEXTS, SF_SMALL, _workers, odd_docs  # noqa: F401

from tabsense.llm import stratified_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group(0).lower(), text or ""))


def brute(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, total = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c, n in counts:
            m = 25 + 75 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(map(repr, out))


def frames(spark, docs, items):
    return (spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("m", F.lit(1)),
            spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash")).withColumn("doc_id", F.lit(0)))


def corpus(n, seed):
    """Zipf words; a third of the texts have one length; repeated texts, ties, odd texts, repeated and NULL ids."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=7 if i % 3 == 0 else rng.randint(0, 60)))) for i in range(n)]
    docs += [(n + i, docs[5][1].upper()) for i in range(30)] + [(None, docs[7][1]), (3, "w1 w2"), (3, "w1 w2")]
    docs += [(2 * n + i, t) for i, t in enumerate(ODD_TEXTS)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 12)))) for i in range(25)]
    items += [(0, items[0][1]), (90, None), (91, ""), (92, "nowhere"), (93, "w0"), (94, "W3 w3, w3"), (95, "word a é 12"), (None, "w5 w6")]
    return docs, items


@pytest.mark.parametrize("options", [{}, dict(block_docs=5, visits=(1, 3)), dict(query_terms=40, block_docs=50, visits=(2,)), dict(k=1), dict(k=1000)])
def test_search_equals_loop(spark, options):
    docs, items = corpus(300, 4)
    got = stratified_search.search(*frames(spark, docs, items), **options)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    want = brute(docs, items, options.get("k", 10))
    assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_empty_tables(spark):
    docs, items = frames(spark, *corpus(20, 1))
    assert stratified_search.search(docs.where("false"), items).count() == 0
    assert stratified_search.search(docs, items.where("false")).count() == 0
    assert stratified_search.search(docs, items.where("item_id = 90")).count() == 0


def test_few_blocks_are_scored(spark):
    """A document with all words of the item leaves few blocks to visit after the first round."""
    rng = random.Random(2)
    docs = [(i, " ".join(f"x{rng.randint(0, 400)}" for _ in range(20 + i % 50))) for i in range(600)]
    item = " ".join(f"rare{j}" for j in range(8))
    docs += [(1000 + i, item) for i in range(12)] + [(2000 + i, f"rare{i % 8} " + docs[i][1]) for i in range(100)]
    got = stratified_search.search(*frames(spark, docs, [(1, item)]), visits=(1,), block_docs=64)
    assert [r.doc_id for r in got.orderBy("rank").collect()] == list(range(1000, 1010))
