"""Language, quality and toxicity: held-out accuracy, and the defined results of odd input."""

import random
import zlib

import numpy as np
import pytest
from llm_fixtures import _workers, odd_docs  # noqa: F401

from tabsense.llm import langid, quality, queries, toxicity
from tabsense.llm.common import fold
from tabsense.llm.features import NAMES, dense

SF = "/root/testdata/sf0.01"


def frame(*dfs):
    out = dfs[0]
    for d in dfs[1:]:
        out = out.join(d, "doc_id")
    return out.toPandas()


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for v in np.unique(score):
        rank[score == v] = rank[score == v].mean()
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_folds_are_crc32_of_the_decimal_id(spark):
    from pyspark.sql import functions as F
    rows = spark.range(200).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    p = frame(queries.op8_nb_langid(spark, SF), docs)
    held = p[p.held_out]
    assert len(p) == 1000 and (held.lang_pred == held.lang).mean() > 0.98 and p.score.between(0, 1).all()
    assert (p.held_out == p.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()


def test_language_equals_brute_force(spark):
    """The same counts and sums by a plain loop over characters."""
    rows = [(0, "aab ab", "x"), (1, "bba b", "y"), (2, "ab ab!", "x"), (3, "zz top", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, orders=(1, 2, 3), buckets=1 << 12)

    def grams(text):
        for word in text.lower().split():
            for run in "".join(c if c.isalpha() else " " for c in word).split():
                padded = f"^{run}$"
                yield from run
                yield from (padded[i:i + 2] for i in range(len(padded) - 1))
                yield from (padded[i:i + 3] for i in range(len(padded) - 2))
    import pyarrow as pa
    for text in ("aab", "ab", "x9y-z", "été"):
        bucket, _, has = langid.ngrams(pa.array([text.encode()], pa.large_binary()), (1, 2, 3), 1 << 30)
        assert len(bucket) == len(list(grams(text))) and has.all()
        assert len(set(bucket)) == len(set(grams(text)))
    counts = {"x": {}, "y": {}}
    for _, text, lang in rows[:3]:
        for g in grams(text):
            counts[lang][g] = counts[lang].get(g, 0) + 1
    total = {k: sum(v.values()) + langid.SMOOTHING * (1 << 12) for k, v in counts.items()}
    log = lambda k, g: np.log((counts[k].get(g, 0) + langid.SMOOTHING) / total[k])
    got = langid.predict(docs.withColumn("held_out", docs.doc_id < 0), model).orderBy("doc_id").collect()
    for (_, text, _), r in zip(rows, got):
        s = np.array([np.log(p) + sum(log(k, g) for g in grams(text)) for k, p in (("x", 2 / 3), ("y", 1 / 3))])
        assert r.lang_pred == "xy"[s.argmax()] and abs(r.score - 1 / (1 + np.exp(s.min() - s.max()))) < 1e-3


def test_language_odd_input(spark, odd_docs):
    from pyspark.sql import functions as F
    docs = odd_docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "bb").when(F.col("doc_id") % 3 == 0, "aa")).withColumn("held_out", F.lit(False))
    out = langid.predict(docs, langid.train(docs)).collect()
    assert len(out) == docs.count()
    letterless = {r.doc_id for r in docs.collect() if not any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in out if r.lang_pred == "und"} == letterless and all(r.score == 0 for r in out if r.lang_pred == "und")
    nothing = langid.predict(docs, langid.train(docs.where("false"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert langid.predict(docs.where("false"), langid.train(docs)).count() == 0
    with pytest.raises(ValueError):
        langid.train(docs, max_languages=1)


def test_features_are_finite_and_per_text():
    texts = ["", " ", "One two two two.\nThree!!! FOUR", "x", "é è", "*** ###", "a b c d e a b c d e a b c d e"]
    raw = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(x) for x in raw]))
    x = dense(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert x.shape == (7, len(NAMES)) and np.isfinite(x).all()
    for i, r in enumerate(raw):  # a text's features do not depend on its neighbours
        assert np.allclose(x[i], dense(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0])
    f = dict(zip(NAMES, x[2]))
    assert f["same_as_last"] == pytest.approx(1 / 6) and f["top_word"] == pytest.approx(1 / 3) and f["shouted_words"] == pytest.approx(1 / 6)
    assert dict(zip(NAMES, x[6]))["distinct_shingles"] == pytest.approx(5 / 11)


def test_prior_estimate():
    rng = np.random.default_rng(0)
    p, n = rng.beta(8, 2, 20000), rng.beta(2, 8, 20000)
    for share in (0.3, 0.6, 0.9):
        u = np.where(rng.random(20000) < share, rng.permutation(p), n)
        assert abs(quality.estimate_prior(p, u) - share) < 0.06


def test_non_negative_risk_learns_from_positives_alone():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1.5, 1, (6000, 4)), rng.normal(-1.5, 1, (6000, 4))
    u = np.concatenate([good[3000:5100], bad[:900]])
    m = quality.fit(good[:3000], u, 0.7)
    assert (m.score(good[5100:]) > 0.5).mean() > 0.95 and (m.score(bad[900:]) < 0.5).mean() > 0.95


def test_quality_held_out(spark):
    p = frame(queries.op3_pu_quality(spark, "/root/testdata/sf0.1"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    held = p[p.held_out]
    assert auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.97 and (held.predicted == held.quality).mean() > 0.97


def test_toxicity_held_out(spark):
    p = frame(queries.op6_gbt_toxicity(spark, "/root/testdata/sf0.1"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    held = p[p.held_out]
    assert auc(held.score.to_numpy(), held.toxic.to_numpy()) > 0.93
    assert held[held.toxic == 1].predicted.mean() > 0.85 and held[held.toxic == 0].predicted.mean() < 0.02


def test_word_forms():
    assert toxicity.normal("IDIOT!!") == ("idiot", False)
    assert toxicity.normal("1d10t") == ("idiot", True) and toxicity.normal("st*pid,") == ("stpid", True)
    assert toxicity.normal("***") == ("", False) and toxicity.normal("12") == ("", False)


def test_prior_of_the_corpus_equals_scores_at_hand(spark, odd_docs):
    """One histogram over all rows gives what the scores themselves give."""
    model = quality.fit(np.random.default_rng(0).normal(size=(50, len(NAMES))), np.random.default_rng(1).normal(size=(50, len(NAMES))), None, epochs=1)
    docs = odd_docs.unionByName(odd_docs).select("text").repartition(3)
    scores = np.array([r.s for r in quality.score(docs, model, "s").collect()])
    for positive in (np.array([0.5]), np.quantile(scores, [0.3, 0.5, 0.9]), np.array([0.0, 2.0])):
        assert quality.corpus_prior(docs, model, positive) == quality.estimate_prior(positive, scores)


def test_toxic_rows_are_learned_however_rare(spark):
    """Three toxic rows among many; and one id on a third of the rows."""
    rng = random.Random(4)
    words = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=12))) for i in range(1500)] + [(5000 + i, " ".join(["vileword you"] * 6)) for i in range(3)]
    rows += [(7, rows[7][1])] * 700
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 5000)) for i in {i for i, _ in rows}], "doc_id long, toxic int")
    dealt = toxicity._dealt(labels, 600)
    assert len(dealt) == 600 and dealt.groupby("toxic")["part"].nunique().tolist() == [3, 3]
    assert abs(dealt.groupby("toxic")["weight"].sum()[0] - 1500) < 1e-6
    model = toxicity.train(docs, labels, 600)
    assert model.trees is not None and abs(model.share - 3 / 1503) < 1e-9
    for n in (1, 2):
        few = toxicity._dealt(labels.where(f"toxic = 0 or doc_id < {5000 + n}"), 600)
        assert sorted(few[few.toxic == 1].part) == sorted(["trees", "calibration", "lexicon"] * n)


def test_classifiers_odd_input(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None), (3, 1, 0)], "doc_id long, good int, toxic int")
    model, _ = quality.train(odd_docs, labels)
    out = quality.score(odd_docs, model).collect()
    assert len(out) == odd_docs.count() and all(0 <= r.score <= 1 for r in out) and out[0].asDict().keys() == {*odd_docs.columns}
    none, _ = quality.train(odd_docs, labels.where("false"))
    assert none is None and {r.score for r in quality.score(odd_docs, None, "s").collect()} == {0.5}
    tox = toxicity.train(odd_docs, labels)
    out = toxicity.score(odd_docs, tox).collect()
    assert len(out) == odd_docs.count() and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in toxicity.score(odd_docs, toxicity.train(odd_docs, labels.where("false"))).collect()} == {0.0}
    assert quality.score(odd_docs.where("false"), model).count() == 0


def test_features_of_many_texts_hold_little_memory():
    """What a worker holds beside its batch is that of one block of text; an executor has a worker for each of its cores."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(5000)]
    batch = pa.record_batch([pa.array([" ".join(rng.choices(words, k=160)) for _ in range(6000)])], names=["text"])
    lex = SimpleNamespace(value={w: 1.0 for w in words[:100]})
    tracemalloc.start()
    rows = sum(b.num_rows for b in toxicity.feature_batches(iter([batch]), lex))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 6000 and peak < 100e6
