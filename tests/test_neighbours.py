import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsense.operators import features as FE
from tabsense.operators import neighbours as NB


def _points(kind: str, n: int = 260):
    rng = random.Random(5)
    if kind == "grid":  # many equal distances
        return [(float(i % 20), float(i // 20)) for i in range(n)]
    if kind == "clusters":  # one tight cluster holds most points
        return sorted({(round(rng.gauss(0, 0.01) if i % 3 else rng.uniform(-50, 50), 6), round(rng.gauss(0, 0.01), 6)) for i in range(n)})
    return [(rng.random(), rng.random() * 1e6) for _ in range(n)]


@pytest.mark.parametrize("kind", ["grid", "clusters", "uneven"])
def test_nearest_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(NB, "BLOCK_POINTS", 32)
    rows, k = [(c, 1000 * c + i, list(p), 1 + i % 3) for c, n in ((1, 260), (2, 4), (3, 1)) for i, p in enumerate(_points(kind, n))], 5
    df = spark.createDataFrame(rows, "_k int, _pid long, x array<double>, m long")
    got = {r["_pid"]: [(v["d"], tuple(v["x"]), v["m"]) for v in r["near"]] for r in NB.nearest(df, k).collect()}
    assert set(got) == {r[1] for r in rows}
    for c, pid, x, _ in rows:
        others = [r for r in rows if r[0] == c and r[1] != pid]
        d = NB.distances(np.array([x]), np.array([r[2] for r in others]).reshape(-1, 2))[0] if others else []
        assert got[pid] == sorted((float(v), tuple(r[2]), r[3]) for v, r in zip(d, others))[:k]


def test_smote_rows_lie_between_a_row_and_one_of_its_nearest(spark):
    """Features called as the operator's own columns, a row that repeats, missing cells."""
    rng = random.Random(2)
    small = [(round(rng.uniform(0, 9), 3), float(rng.randrange(5)), "s") for _ in range(30)] + [(50.0, 1.0, "s")] * 9
    df = spark.createDataFrame([(float(i), 0.0, "big") for i in range(150)] + small + [(None, 3.0, "n")], "x double, m double, label string")
    k = 3
    made = [(r["x"], r["m"]) for r in FE.smote(df, "label", ["x", "m"], k=k).where("synthetic AND label = 's'").collect()]
    assert len(made) == 150 - len(small)
    pts = np.array([r[:2] for r in small])
    pairs = []
    for i, p in enumerate(pts):
        d = NB.distances(p[None, :], pts)[0]
        d[i] = -1
        limit = np.sort(d)[min(k, len(d) - 1)]
        pairs += [(p, pts[j]) for j in np.flatnonzero((d <= limit)) if j != i]
    for s in np.array(made):
        gaps = [abs(np.linalg.norm(s - a) + np.linalg.norm(b - s) - np.linalg.norm(b - a)) for a, b in pairs]
        assert min(gaps) < 1e-6
    lone = FE.smote(df, "label", ["x", "m"], k=k).where("synthetic AND label = 'n'").agg(F.count("x"), F.count("*"), F.min("m")).first()
    assert tuple(lone) == (0, 149, 3.0)


def test_a_block_is_searched_as_arrays():
    """A block's search takes and gives Arrow tables (no Python object per row) and orders ties by the features; a row of many
    equal distances, a block smaller than k and an empty one."""
    import pyarrow as pa
    rng = np.random.default_rng(3)
    for n, k in ((60, 5), (3, 5), (0, 5)):
        x = np.unique(rng.integers(0, 4, (n, 3)), axis=0).astype(float) if n else np.zeros((0, 3))
        x = x[rng.permutation(len(x))]
        held = pa.table({"hx": pa.array(x.tolist(), pa.list_(pa.float64())), "h_pid": pa.array(range(len(x)), pa.int64()), "hm": pa.array([2] * len(x), pa.int64())})
        asked = x if n else np.ones((2, 3))
        asking = pa.table({"_k": pa.array([1] * len(asked), pa.int32()), "_pid": pa.array(range(len(asked)), pa.int64()), "x": pa.array(asked.tolist(), pa.list_(pa.float64()))})
        got = NB._block(k)(asking, held).to_pylist()
        for i, r in enumerate(got):
            order = sorted((float(np.sqrt(((asked[i] - y) ** 2).sum())), tuple(y)) for j, y in enumerate(x) if j != i)[:k]
            assert r["_pid"] == i and [(e["d"], tuple(e["x"])) for e in r["near"]] == order and all(e["m"] == 2 for e in r["near"])
        assert len(got) == len(asked)
