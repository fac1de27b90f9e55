"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; the
two classifiers learn from the labels of the training folds among them.  All
but the last return the columns of ``docs``.  Defined results: a NULL text is
judged as an empty one by the classifiers, passes the line stage unchanged and
is packed as an end id alone; rows with NULL ids are kept row by row; labels
that are absent leave everything in (see the operators for ties and repeats).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsense.llm import line_spread, packing, quality, shingle_join, toxicity
from tabsense.llm.common import read, worker_path, written
from tabsense.llm.queries import quality_training, tokenizer_path, toxicity_training


def _passed(scored: DataFrame, docs: DataFrame, condition) -> DataFrame:
    return scored.where(condition).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    worker_path(spark)
    model = toxicity.train(*toxicity_training(docs, read(spark, sf_dir, "labels")))
    return _passed(toxicity.score(docs, model, "_toxicity"), docs, F.col("_toxicity") < toxicity.THRESHOLD)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; all, where no label says what is good."""
    worker_path(spark)
    model, _ = quality.train(*quality_training(docs, read(spark, sf_dir, "labels")))
    if model is None:
        return docs
    return _passed(quality.score(docs, model, "_quality"), docs, F.col("_quality") >= quality.THRESHOLD)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sites share; n_chars, if there is one, counts the text that is left."""
    cleaned = line_spread.remove_boilerplate(docs)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cleaned.select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    worker_path(spark)
    return shingle_join.deduplicate(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    worker_path(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("line_dedup", drop_boilerplate_lines),
          ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: SQL can express neither the classifiers nor the tokenizer; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
