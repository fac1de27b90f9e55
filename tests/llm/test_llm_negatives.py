"""Hard negatives against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import _workers  # noqa: F401

from tabsense.llm import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, every, positives=5, k=10):
    rows = [(i, c, np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)) for i, c, v in rows]
    out = []
    for a, la, va in rows:
        if a % every:
            continue
        scored = [(-int(va @ v), i, c) for i, c, v in rows if i != a and len(v) == len(va)]
        for ps, p, _ in sorted(x for x in scored if x[2] == la)[:positives]:
            inside = sorted(x for x in scored if x[2] != la and 30 * -ps <= 100 * -x[0] <= 90 * -ps)
            out += [(a, p, r + 1, i, -ps, -s) for r, (s, i, _) in enumerate(inside[:k])]
    return sorted(out)


def vectors(n, dim, seed, clusters=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    if clusters:
        x = 3 * rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] + x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[10:n // 3] = x[10]  # one very common vector
    label = rng.integers(0, 4, n)
    label[10:n // 4] = 1
    return [(i, int(c), v.astype(np.float32).tolist()) for i, (c, v) in enumerate(zip(label, x))]


@pytest.mark.parametrize("dim, clusters, options", [(64, 0, {}), (64, 12, dict(first_rows=40)), (7, 0, dict(first_rows=1)), (1, 0, {}), (2, 3, dict(k=3, positives=2, first_rows=20)),
                                                    (16, 0, dict(anchor_bytes=900))])
def test_mining_equals_brute_force(spark, monkeypatch, dim, clusters, options):
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 16)
    rows = vectors(400, dim, dim, clusters)
    df = spark.createDataFrame(rows + rows[:3], SCHEMA).withColumn("rank", F.lit("clash")).withColumn("id", F.lit("clash"))
    got = hard_negatives.mine(hard_negatives.integer_vectors(df), 20, **options)
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert sorted(map(tuple, got.collect())) == brute(rows, 20, options.get("positives", 5), options.get("k", 10))


def test_odd_rows(spark):
    good = vectors(60, 8, 3) + [(100, 1, [0.0] * 8), (120, 0, [3e6, -2.5e6, 1e6, 0.0, 9.0, 1.0, 1.0, 1.0]), (140, 0, [5e6, -1.5e6, 1e6, 0.0, 9.0, 1.0, 1.0, 1.0]),
                                (160, 2, [4e6, -1.5e6, 1e6, 0.0, 9.0, 1.0, 1.0, 1.0]), (200, 0, [1.0, 2.0]), (220, 0, [1.0, 2.5]), (221, 3, [1.0, 1.0]), (240, 9, [1.0])]
    bad = [(0, None, good[1][2]), (None, 1, good[1][2]), (300, 1, None), (320, 1, []), (340, 1, [None] * 8), (360, 1, [float("nan")] * 8), (380, 1, [float("-inf")] * 8)]
    made = hard_negatives.integer_vectors(spark.createDataFrame(good + bad, SCHEMA))
    assert sorted(map(tuple, hard_negatives.mine(made, 20).collect())) == brute(good, 20)
    assert hard_negatives.mine(made.where("false"), 20).count() == 0
    assert hard_negatives.mine(made.where("id % 20 <> 0"), 20).count() == 0
    assert hard_negatives.mine(made.where("label = '1'"), 20).count() == 0


def test_heap_visits_every_cell_in_order():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (1, 7), (9, 1), (12, 17)):
        held = rng.integers(0, 3, (n, m))
        cells = hard_negatives.Cells([rng.normal(size=(n, 4)), rng.normal(size=(m, 3))], [rng.random(n), rng.random(m)], held)
        seen = list(cells.visit(rng.normal(size=7)))
        assert sorted((a, b) for a, b, _, _ in seen) == sorted(zip(*map(list, np.nonzero(held))))
        tops = [top for *_, top in seen]
        assert tops == sorted(tops, reverse=True)


def test_bounds_hold():
    rng = np.random.default_rng(6)
    x = rng.integers(-256, 256, (500, 9))
    books = [hard_negatives.codebook(p, 6) for p in (x[:, :5], x[:, 5:])]
    (c1, d1), (c2, d2) = hard_negatives.nearest(x[:, :5].astype(float), books[0]), hard_negatives.nearest(x[:, 5:].astype(float), books[1])
    radii = [np.array([d[c == i].max(initial=0) for i in range(len(b))]) for c, d, b in ((c1, d1, books[0]), (c2, d2, books[1]))]
    cells = hard_negatives.Cells(books, radii, np.ones((6, 6)))
    for a in x[:20]:
        (l1, h1), (l2, h2) = cells.bounds(a.astype(float))
        s = x @ a
        assert (l1[c1] + l2[c2] <= s).all() and (s <= h1[c1] + h2[c2]).all()


def test_large_numbers_are_exact():
    a = np.array([[2 ** 40 + 1, 3]])
    assert hard_negatives.products(a, np.array([[5, 7], [2 ** 20 + 1, 1]])).tolist() == [[5 * (2 ** 40 + 1) + 21, (2 ** 40 + 1) * (2 ** 20 + 1) + 3]]
