"""Line spread, binary codes, cross-polytope search and the shingle join against brute force."""

import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm_fixtures import SF_SMALL, _workers, odd_docs  # noqa: F401

from tabsense.llm import cross_polytope, line_spread, multi_index, queries, shingle_join


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, SF_SMALL), con.sql(queries.ORACLE[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    assert sorted(repr(tuple(r[c] for c in order)) for r in df.collect()) == sorted(repr(r) for r in want.project(", ".join(order)).fetchall())


# --- line spread ---------------------------------------------------------------

def test_lines_equal_brute_force(spark):
    rng = random.Random(3)
    lines = [f"line {i}" for i in range(30)] + ["", "  ", " line 1 "]
    rows = [(i, rng.choice([*(f"s{k}" for k in range(12)), None]), "\n".join(rng.choices(lines, [40 / (k + 1) for k in range(len(lines))], k=rng.randint(0, 6))))
            for i in range(400)] + [(900, "s1", None), (None, "s2", "line 0\nonly here"), (901, "s1", "line 0"), (901, "s1", "line 0")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n_lines", F.lit("clash")).withColumn("_line", F.lit(1))
    for least in (2, 8, 12):
        sites = {}
        for _, s, t in rows:
            for x in (t or "").split("\n"):
                if x.strip(" ") and s is not None and t is not None:
                    sites.setdefault(x.strip(" "), set()).add(s)
        wide = {x for x, s in sites.items() if len(s) >= least}
        want = [(i, None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" ") not in wide),
                 0 if t is None else len(t.split("\n")), 0 if t is None else sum(x.strip(" ") in wide for x in t.split("\n"))) for i, _, t in rows]
        got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_spread.remove_boilerplate(docs, min_sites=least).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert line_spread.remove_boilerplate(docs.where("false")).count() == 0


def test_lines_of_a_very_long_text(spark):
    """200,000 lines, half of them on many sites."""
    long = "\n".join(f"mine {i}" if i % 2 else f"menu {i % 10}" for i in range(200_000))
    menu = "\n".join(f"menu {i}" for i in range(0, 10, 2))
    docs = spark.createDataFrame([(i, f"site{i}", menu) for i in range(9)] + [(100, "own", long)], "doc_id long, source string, text string")
    r = line_spread.remove_boilerplate(docs).where("doc_id = 100").first()
    assert (r.n_lines, r.n_removed) == (200_000, 100_000) and r.text == "\n".join(f"mine {i}" for i in range(1, 200_000, 2))


def test_lines_stay_in_spark(spark):
    text = plan(queries.op2_line_spread(spark, SF_SMALL))
    assert not re.search("Python|Pandas|Arrow|Cartesian|BroadcastNestedLoop", text)


def test_many_sites_far_and_near_the_limit(spark):
    """Lines of 1 to 300 sites: those near the limit are counted exactly, the estimate decides the others."""
    rows = [(k * 1000 + i, f"site{i}", f"line {k}") for k in (1, 95, 99, 100, 101, 105, 300) for i in range(k)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    gone = {r.doc_id // 1000 for r in line_spread.remove_boilerplate(docs, min_sites=100).where("n_removed > 0").collect()}
    assert gone == {100, 101, 105, 300}


# --- vectors ---------------------------------------------------------------------

def vectors(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[50:90] = x[50]  # one very common vector
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1020, []), (1040, [0.0] * 64), (1060, [float("nan")] * 64), (1080, [None] * 64), (1100, [float("inf")] + [1.0] * 63), (None, rows[3][1])]
    return rows, spark.createDataFrame(rows + odd + rows[:5], "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))


@pytest.mark.parametrize("k", [1, 10])
def test_multi_index_equals_brute_force(spark, k):
    rows, df = vectors(spark, 150)
    bits = {i: np.array(v) > 0 for i, v in rows}
    coded = multi_index.codes(df)
    got = multi_index.search(coded, coded.where("id % 20 = 0"), k).collect()
    want = []
    for q in range(0, 150, 20):
        near = sorted(((bits[q] != bits[i]).sum(), i) for i in bits if i != q)[:k]
        want += [(q, r + 1, i, int(d)) for r, (d, i) in enumerate(near)]
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("dim", [1, 7, 128, 200])
def test_multi_index_takes_every_component(spark, dim):
    """Codes of any length; vectors that differ in their last components only; shorter ones among them."""
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(90, dim))
    x[30:60, :max(dim - 3, 0)] = x[30, :max(dim - 3, 0)]
    rows = [(i, [float(c) for c in (v[:dim // 2] if i % 9 == 4 and dim > 1 else v)]) for i, v in enumerate(x)]
    bits = {i: np.pad(np.array(v) > 0, (0, dim - len(v))) for i, v in rows}
    coded = multi_index.codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    want = [(q, r + 1, i, int(d)) for q in range(0, 90, 20)
            for r, (d, i) in enumerate(sorted(((bits[q] != bits[i]).sum(), i) for i in bits if i != q)[:5])]
    assert sorted(map(tuple, multi_index.search(coded, coded.where("id % 20 = 0"), 5).collect())) == want
    assert multi_index.search(coded.where("false"), coded).count() == 0


def test_multi_index_few_rows(spark):
    rows, df = vectors(spark, 100)
    few = multi_index.codes(df.where("vec_id in (0, 7, 20)"))
    got = multi_index.search(few, few.where("id % 20 = 0")).collect()
    assert sorted((r.query_id, r["rank"]) for r in got) == [(0, 1), (0, 2), (20, 1), (20, 2)]
    none = few.where("false")
    assert multi_index.search(none, none).count() == 0


def test_cross_polytope_recall_and_scores(spark):
    rows, df = vectors(spark, 3000, 5)
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    m = np.stack([x[i] for i in range(3000)])
    got = cross_polytope.search(cross_polytope.valid(df)).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
        assert r.score == pytest.approx(np.sqrt(((x[r.query_id] - x[r.vec_id]) ** 2).sum()), abs=1e-12) and r.vec_id != r.query_id
    assert set(by) == set(range(0, 3000, 100))
    hits = 0
    for q, own in by.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        d = np.sqrt(((m - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len({r.vec_id for r in own} & set(np.lexsort((np.arange(3000), d))[:10].tolist()))
    assert hits / (10 * len(by)) >= 0.9


def test_cross_polytope_groups_are_split(spark, monkeypatch):
    _, df = vectors(spark, 400)
    whole = sorted(map(tuple, cross_polytope.search(cross_polytope.valid(df), every=20).collect()))
    monkeypatch.setattr(cross_polytope, "GROUP_ENTRIES", 2)
    monkeypatch.setattr(cross_polytope, "GROUP_QUERIES", 1)
    assert sorted(map(tuple, cross_polytope.search(cross_polytope.valid(df), every=20).collect())) == whole
    few = cross_polytope.valid(df.where("vec_id in (0, 3, 1000, 1100)"))
    assert [(r.query_id, r.vec_id) for r in cross_polytope.search(few).collect()] == [(0, 3)]
    assert cross_polytope.search(few.where("false")).count() == 0


def test_pseudo_rotation_keeps_length():
    x = np.random.default_rng(0).normal(size=(20, 50))
    for y in cross_polytope.rotations(x, 3, 1):
        assert y.shape == (20, 64) and np.allclose(np.linalg.norm(y, axis=1), 1)
    y = np.array([[0.1, -3.0, 2.0, 0.5]])
    assert cross_polytope.axes(y, 3).tolist() == [[5, 2, 3]]


# --- shingle join ------------------------------------------------------------------

def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(rows):
    """Component ids by comparing every pair."""
    s, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(repr((d, len(s[i]), least.get(find(i)) if s[i] else d)) for i, (d, _) in enumerate(rows))


def near_copies(seed):
    """Families of copies with edits, at every similarity, a passage that many texts share, and odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    passage, rows = " ".join(word() for _ in range(30)), []
    for family in range(6):
        base = [word() for _ in range(rng.choice([5, 12, 60, 150]))]
        for _ in range(rng.choice([2, 12])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
    for _ in range(15):
        rows.append(passage + " " + " ".join(word() for _ in range(rng.choice([3, 10, 100]))))
    rows += [None, "", " \n", "one two", "ONE  two", "one two three", "a b c d e", "A b\tc d e", rows[0], rows[0]]
    out = [(i * 3, t) for i, t in enumerate(rng.sample(rows, len(rows)))]
    return out + [(None, rows[0]), (None, None), out[4]]


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed):
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("n", F.lit(0)).repartition(3)
    got = sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in shingle_join.join(docs).collect())
    assert got == brute(rows)
    kept = shingle_join.deduplicate(docs).collect()
    components = {eval(x)[2] for x in brute([r for r in rows if r[0] is not None and shingles(r[1])])}
    assert sorted(r.doc_id for r in kept if shingles(r.text)) == sorted(components) and kept[0].asDict().keys() == {*docs.columns}
    assert {r.doc_id for r in kept if not shingles(r.text)} == {d for d, t in rows if not shingles(t)}


def mosaics(seed, n=110, passages=30, of=8):
    """Texts that share passages and do not link, with a few near copies of some, and a family whose copies have edits of their own."""
    rng = random.Random(seed)
    parts = [" ".join(f"p{i}x{j}" for j in range(40)) for i in range(passages)]
    rows = [(i, " ".join(rng.sample(parts, of))) for i in range(n)]
    for i in range(0, n, 10):
        w = rows[i][1].split()
        w[rng.randrange(len(w))] = "edited"
        rows.append((n + i, " ".join(w)))
    base = [f"b{i}" for i in range(150)]
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = f"e{i}"
        rows.append((1000 + i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_mosaics_and_families_equal_brute_force(spark, seed):
    rows = mosaics(seed)
    got = shingle_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == brute(rows)


def test_orders_prune_before_texts_move(spark, monkeypatch):
    """Of the pairs of mosaics that share a shingle, few are left to verify."""
    moved = []
    verify = shingle_join._verify
    monkeypatch.setattr(shingle_join, "_verify", lambda pairs, texts: moved.append(pairs.count()) or verify(pairs, texts))
    rows = [r for r in mosaics(3, n=200) if r[0] < 200]
    assert shingle_join.join(spark.createDataFrame(rows, "doc_id long, text string")).count() == 200
    assert sum(moved) < 200 * 199 / 2 * 0.15


def test_join_takes_a_very_long_text(spark):
    text = " ".join(f"w{i % 90_001}" for i in range(250_000))
    rows = [(1, text), (2, text + " end"), (3, "short")]
    assert [r.component_id for r in shingle_join.join(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()] == [1, 1, 3]


def test_join_without_rows_or_links(spark):
    docs = spark.createDataFrame([(1, "all alone here"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, shingle_join.join(docs).collect())) == [(1, 1, 1), (2, 0, 2)]
    assert shingle_join.join(docs.where("false")).count() == 0 and shingle_join.deduplicate(docs).count() == 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=60), st.lists(st.integers(0, 60), min_size=1, max_size=60))
def test_filters_lose_no_pair(a, b):
    """linked() decides as sets do, and a linked pair shares a shingle within the first n // 5 + 1 under any order."""
    mix = lambda v: shingle_join._mix(np.array(v, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(99))
    x, y = (np.unique(mix(v)) for v in (a, b))
    want = 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))
    assert shingle_join.linked(x, y) == want
    if want:
        assert len(np.intersect1d(x[:len(x) // 5 + 1], y[:len(y) // 5 + 1]))
        spare = min(shingle_join._spare(len(x)), shingle_join._spare(len(y)))
        heads = [v[:len(v) // 5 + shingle_join._spare(len(v))] for v in (x, y)]
        assert len(np.intersect1d(*heads)) >= spare


def test_components_of_long_chains(spark):
    rng = random.Random(0)
    chain = list(range(200))
    rng.shuffle(chain)
    links = [(a, b) for a, b in zip(chain, chain[1:])] + [(1000, 1001), (1001, 1000), (5, 5)]
    roots = {r.key: r.root for r in shingle_join.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert roots == {**{i: 0 for i in range(1, 200)}, 1001: 1000}
