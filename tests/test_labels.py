"""Frequent values with late text and label codes, against plain loops."""

from collections import Counter

import pytest

from tabsense.functions import frequencies as FQ
from tabsense.functions import labels as LB
from tabsense.operators import features as FE
from tabsense.operators import profile as P

STEM = "the same first thirty-two characters, "


def _rows():
    long = [STEM + "x" * (i % 7) + str(i % 11) for i in range(400)]
    return [(long[i], None if i % 5 == 0 else f"v{i % 13}", STEM if i % 2 else None, None) for i in range(400)]


def _plain(values, k):
    counts = Counter(v for v in values if v is not None)
    return sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:k]


@pytest.mark.parametrize("limit", [0, 100_000])
@pytest.mark.parametrize("k", [1, 5, 1000])
def test_frequent_values_equal_a_plain_count(spark, monkeypatch, k, limit):
    """Long values that share their head, ties beyond k, NULLs and a column without values; keys broadcast or joined."""
    monkeypatch.setattr(FQ, "BROADCAST_KEYS", limit)
    rows = _rows()
    df = spark.createDataFrame(rows, "a string, b string, c string, d string").repartition(3)
    got = FQ.frequent_values(df, df.columns, k).collect()
    for i, c in enumerate(df.columns):
        mine = sorted((r for r in got if r["column_name"] == c), key=lambda r: r["rank"] or 0)
        values = [r[i] for r in rows]
        assert [(r["value"], r["count"]) for r in mine if r["rank"]] == _plain(values, k)
        assert {(r["known"], r["missing"], r["n_unique"]) for r in mine} == {
            (400 - values.count(None), values.count(None), len(set(values) - {None}))}
    assert [r["rank"] for r in got if r["column_name"] == "d"] == [None]


def test_frequent_values_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert P.top_values(df).collect() == []
    assert P.profile_categorical(df).collect() == []
    assert [tuple(r) for r in P.frequency_summary(df, "a").collect()] == [("a", 0, None, 0)]


def test_long_texts_are_not_shuffled(spark):
    """A whole text reaches an exchange only as one of the winners: the grouped cells carry a head."""
    df = spark.createDataFrame([("x" * 5000 + str(i),) for i in range(20)], "a string")
    plan = FQ._counts(df, ["a"])._jdf.queryExecution().executedPlan().toString()
    group = next(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)
    assert "head" in group and "h1" in group
    assert [f.name for f in FQ._counts(df, ["a"]).schema] == ["position", "h1", "h2", "head", "long", "count"]


@pytest.mark.parametrize("limit, share", [(100_000, 1000), (0, 4), (0, 1)])
def test_codes_equal_sorted_places(spark, monkeypatch, limit, share):
    """All labels broadcast; hot ones broadcast and the others joined; a hot label, NULLs, an all-NULL column, repeated rows."""
    monkeypatch.setattr(LB, "BROADCAST_LABELS", limit)
    monkeypatch.setattr(LB, "HOT_SHARE", share)
    a = ["hot" if i % 3 == 0 else f"é{i % 40}" if i % 2 else f"Z{i % 17}" for i in range(300)]
    b = [None if i % 4 == 0 else str(i % 23) for i in range(300)]
    df = spark.createDataFrame([(i // 2, x, y, None) for i, (x, y) in enumerate(zip(a, b))], "k int, `a.x` string, b string, c string")
    out, sizes = LB.encode(df, ["a.x", "b", "c"], buckets=4)
    assert sizes == [len(set(a)), len(set(b) - {None}), 0]
    places = [{v: n for n, v in enumerate(sorted(set(col) - {None}, key=lambda v: v.encode()))} for col in (a, b)]
    want = sorted(((i // 2, places[0][x], -1 if y is None else places[1][y]) for i, (x, y) in enumerate(zip(a, b))))
    got = out.collect()
    assert sorted((r["k"], r["a.x"], -1 if r["b"] is None else r["b"]) for r in got) == want
    assert {r["c"] for r in got} == {None}


def test_target_keeps_its_inverse_mapping(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("b", 4)], "y string, x int")
    assert sorted((r["x"], r["target_code"]) for r in FE.encode_target(df, "y").collect()) == [(1, 1.0), (2, 0.0), (4, 1.0)]
    assert sorted(tuple(r) for r in FE.target_classes(df, "y").collect()) == [(0.0, "a", 1), (1.0, "b", 2)]
    assert FE.target_classes(df.where("x = 3"), "y").collect() == []
