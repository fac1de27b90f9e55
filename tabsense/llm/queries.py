"""The registered query of each operator, with production parameters, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsense.llm import (chunked_bpe, cross_polytope, hard_negatives, langid, license_scan, line_spread, multi_index, packing,
                          quality, shingle_join, stratified_search, token_counts, toxicity)
from tabsense.llm.common import fold, read


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer file lies; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hierarchical_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_line_spread(spark, sf_dir):
    cleaned = line_spread.remove_boilerplate(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", "text")


def quality_training(docs, labels):
    """Rows of the training folds: crc32 of the id modulo 4 is not 2."""
    return (docs.where(fold(F.col("doc_id"), 4) != 2),
            labels.where(fold(F.col("doc_id"), 4) != 2).select("doc_id", F.col("quality").alias("good")))


def op3_pu_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model, _ = quality.train(*quality_training(docs, read(spark, sf_dir, "labels")))
    return (quality.score(docs, model)
            .select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")))


def op4_multi_index_hashing(spark, sf_dir):
    vectors = multi_index.codes(read(spark, sf_dir, "embeddings"))
    return multi_index.search(vectors, vectors.where("id % 20 = 0"))


def op5_chunked_bpe(spark, sf_dir):
    return chunked_bpe.digests(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def toxicity_training(docs, labels):
    """Rows of the training folds: crc32 of the id modulo 5 is not 0."""
    return (docs.where(fold(F.col("doc_id"), 5) != 0),
            labels.where(fold(F.col("doc_id"), 5) != 0).select("doc_id", "toxic"))


def op6_gbt_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(*toxicity_training(docs, read(spark, sf_dir, "labels")))
    return (toxicity.score(docs, model)
            .select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")))


def op7_token_counts(spark, sf_dir):
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_nb_langid(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs.withColumn("held_out", held_out), model)


def op9_shingle_join(spark, sf_dir):
    return shingle_join.join(read(spark, sf_dir, "documents"))


def op10_cross_polytope(spark, sf_dir):
    return cross_polytope.search(cross_polytope.valid(read(spark, sf_dir, "embeddings")))


def op11_stratified_search(spark, sf_dir):
    return stratified_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_license_scan(spark, sf_dir):
    found = license_scan.scan(read(spark, sf_dir, "documents"))
    base = F.filter("finds", lambda f: f["kind"] == "base")
    starts = F.transform(base, lambda f: f["first_word"])
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                        F.array_max(starts).alias("last_word"), license_scan.labels_of(base).alias("base_labels"),
                        license_scan.labels_of(F.col("finds")).alias("labels"), license_scan.evidence(F.col("finds")).alias("score"))


def op13_hard_negatives(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.mine(hard_negatives.integer_vectors(rows))


QUERIES = {f.__name__: f for f in (
    op1_hierarchical_packing, op2_line_spread, op3_pu_quality, op4_multi_index_hashing, op5_chunked_bpe, op6_gbt_toxicity,
    op7_token_counts, op8_nb_langid, op9_shingle_join, op10_cross_polytope, op11_stratified_search, op12_license_scan, op13_hard_negatives)}

ORACLE = {
    "op2_line_spread": f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
wide AS (
  SELECT trim(line, ' ') AS line FROM lines WHERE trim(line, ' ') <> ''
  GROUP BY 1 HAVING count(DISTINCT source) >= {line_spread.MIN_SITES}),
marked AS (
  SELECT lines.doc_id, lines.line, lines.pos, wide.line IS NOT NULL AS gone
  FROM lines LEFT JOIN wide ON trim(lines.line, ' ') = wide.line),
cleaned AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed, c.text
FROM documents d LEFT JOIN cleaned c USING (doc_id)""",
    "op4_multi_index_hashing": """
WITH pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         list_sum(list_transform(list_zip(q.embedding, v.embedding),
                                 lambda x: CASE WHEN (x[1] > 0) <> (x[2] > 0) THEN 1 ELSE 0 END)) AS distance
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id
  WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(distance AS INTEGER) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs)
WHERE rank <= 10""",
    "op9_shingle_join": """
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM split),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.item = b.item AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.component_id
FROM sets JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON sets.doc_id = c.a""",
    "op11_stratified_search": """
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents
  UNION ALL SELECT 'i', item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
words AS (
  SELECT kind, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM texts),
counts AS (SELECT kind, id, term, CAST(count(*) AS BIGINT) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT id, CAST(sum(tf) AS BIGINT) AS n FROM counts WHERE kind = 'd' GROUP BY id),
totals AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM counts, totals WHERE kind = 'd' GROUP BY term),
norms AS (SELECT id, 100 - 75 + ((75 * n * docs) // terms) AS m FROM lengths, totals),
scores AS (
  SELECT i.id AS item_id, d.id AS doc_id,
         CAST(sum(i.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 8 * m))) AS BIGINT) AS score
  FROM counts i JOIN counts d ON i.term = d.term AND i.kind = 'i' AND d.kind = 'd'
       JOIN weights ON weights.term = i.term JOIN norms ON norms.id = d.id
  GROUP BY i.id, d.id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10""",
    "op13_hard_negatives": """
WITH rows AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
  FROM embeddings WHERE label IS NOT NULL),
pairs AS (
  SELECT a.id AS anchor_id, r.id, a.label = r.label AS same,
         CAST(list_sum(list_transform(list_zip(a.vec, r.vec), lambda x: x[1] * x[2])) AS BIGINT) AS score
  FROM rows a JOIN rows r ON a.id <> r.id WHERE a.id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
ranked AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank,
         id AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN pairs USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 10""",
}
