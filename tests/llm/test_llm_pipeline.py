"""Each pipeline stage against what its operator decides on the stage's own input, and odd tables through all stages."""

import corpus_pipeline
from llm_fixtures import _workers, odd_docs  # noqa: F401
from pyspark.sql import functions as F

from tabsense.llm import quality, toxicity
from test_llm_pairs import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "quality", "line_dedup", "near_duplicates", "packing"]

    clean = stage["toxicity"](spark, docs, SF)
    model = toxicity.train(*corpus_pipeline.toxicity_training(docs, labels))
    want = {r.doc_id for r in toxicity.score(docs, model).collect() if r.score < 0.5}
    assert {r.doc_id for r in clean.collect()} == want and clean.columns == docs.columns

    good = stage["quality"](spark, clean, SF)
    model, _ = quality.train(*corpus_pipeline.quality_training(clean, labels))
    want = {r.doc_id for r in quality.score(clean, model).collect() if r.score >= 0.7}
    assert {r.doc_id for r in good.collect()} == want and good.columns == docs.columns

    source = good.collect()
    lines = stage["line_dedup"](spark, good, SF)
    sites = {}
    for r in source:
        for x in r.text.split("\n"):
            if x.strip(" "):
                sites.setdefault(x.strip(" "), set()).add(r.source)
    wide = {x for x, s in sites.items() if len(s) >= 8}
    got = {r.doc_id: r for r in lines.collect()}
    for r in source:
        text = "\n".join(x for x in r.text.split("\n") if x.strip(" ") not in wide)
        assert got[r.doc_id].text == text and got[r.doc_id].n_chars == (r.n_chars if text == r.text else len(text))
    assert lines.columns == docs.columns

    kept = stage["near_duplicates"](spark, lines, SF)
    components = {eval(x)[2] for x in brute([(r.doc_id, r.text) for r in got.values()])}
    assert {r.doc_id for r in kept.collect()} == components and kept.columns == docs.columns

    pieces = stage["packing"](spark, kept, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == components


def test_odd_tables_pass_all_stages(spark, odd_docs):
    docs = odd_docs.withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.length("text")).withColumn("_toxicity", F.lit(1)).withColumn("_quality", F.lit(1))
    for some in (docs, docs.where("false")):
        out = some
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, SF)
            assert out.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, out, SF).count() == 0 or out.count() > 0
