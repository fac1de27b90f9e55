"""License scan against a plain loop, and the expression parser against its rules."""

import re

import pytest
from pyspark.sql import functions as F

from llm_fixtures import SF_SMALL, _workers, odd_docs  # noqa: F401

from tabsense.llm import license_scan, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group(0).lower(), text or "")


def brute(text):
    w = WORD.findall(lower(text))
    places = [(i, label) for phrase, label in license_scan.BASE.items() for p in [phrase.split()]
              for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    notices = {label for phrase, label in {**license_scan.BASE, **license_scan.NOTICES}.items() for p in [phrase.split()]
               for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p}
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), notices


def parse(text):
    raw = text.encode()
    return license_scan.tokens(raw, 0, len(raw))


@pytest.mark.parametrize("text, level, labels, end", [
    ("MIT", 0, ["mit"], 3),
    ("MIT OR GPL-2.0-only", 0, ["gpl", "mit"], 19),
    ("MIT AND GPL-2.0-only", 2, ["gpl", "mit"], 20),
    ("MIT OR GPL-2.0 AND LGPL-2.1", 0, ["gpl", "lgpl", "mit"], 27),           # AND before OR
    ("(MIT OR GPL-2.0) AND LGPL-2.1", 1, ["gpl", "lgpl", "mit"], 29),
    ("GPL-2.0-or-later WITH Classpath-exception-2.0", 1, ["gpl"], 45),
    ("GPL-2.0 WITH Foo-exception OR AGPL-3.0 AND CC-BY-NC-4.0", 1, ["agpl", "cc-by-nc", "gpl"], 55),
    ("MIT. More text", 0, ["mit"], 3),
    ("MIT and see the file", 0, ["mit"], 3),                                  # the longest well-formed part
    ("MIT OR", 0, ["mit"], 3),
    ("MIT) OR ISC", 0, ["mit"], 3),
    ("GPL-2.0+\nAND MIT", 2, ["gpl"], 8),                                     # one line
    ("Foo-1.0", 3, ["foo"], 7),
    ("((ISC))", 0, ["isc"], 7),
])
def test_expressions(text, level, labels, end):
    found, at = parse(text)
    assert license_scan.evaluate(found) == (level, labels)
    assert at == end


@pytest.mark.parametrize("text", ["", "(MIT", "OR MIT", "see the file", "()", "( OR )", "the", "WITH MIT"])
def test_no_expression(text):
    assert parse(text)[0] == []


def test_long_expressions():
    deep = "(" * 50_000 + "MIT" + ")" * 50_000
    assert license_scan.evaluate(parse(deep)[0]) == (0, ["mit"])
    wide = " AND ".join(["MIT"] * 20_000 + ["GPL-3.0"])
    assert parse(wide)[1] == len(wide)


TEXTS = ["Released under the MIT License.", "mit\n\nLICENSE mit license MIT-License", "permit license", "emit license mit licensee", "mit", "license",
         "GNU General Public License, GNU Lesser General Public License; CC BY-NC 4.0. All rights reserved",
         "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */",
         "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: ISC", "licensed under MIT OR GPL-2.0. licensed under CC BY 4.0", "İMIT LICENSE mit licenseé ccby cc by",
         "SPDX-License-Identifier:", "word " * 200_000 + "apache license"]


def test_scan_equals_loop(spark, odd_docs):  # noqa: F811
    docs = odd_docs.unionByName(spark.createDataFrame([(100 + i, t, "s", 1, 1.0, "t") for i, t in enumerate(TEXTS)], odd_docs.schema)) \
        .withColumn("finds", F.lit("clash")).withColumn("n_words", F.lit("clash")).coalesce(2)
    texts = [r.text for r in docs.orderBy("doc_id", "text").collect()]
    found = license_scan.scan(docs)
    assert found.count() == len(texts)
    want = sorted(repr(brute(t)[:5]) for t in texts)
    base = F.filter("finds", lambda f: f["kind"] == "base")
    starts = F.transform(base, lambda f: f["first_word"])
    got = found.select("n_words", F.size(base), F.array_min(starts), F.array_max(starts), license_scan.labels_of(base)).collect()
    assert sorted(repr(tuple(r)) for r in got) == want
    assert license_scan.scan(docs.where("false")).count() == 0


def test_tags_give_spans_and_terms(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    by_id = {r.doc_id: r.finds for r in license_scan.scan(docs).collect()}
    assert [(f.label, f.first_word, f.expression) for f in by_id[7]] == [
        (x, 0, "(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0") for x in ("apache", "gpl", "mit", "terms:weak-copyleft")]
    assert [(f.label, f.expression) for f in by_id[8] if f.kind == "expression"] == [("mit", "MIT"), ("terms:permissive", "MIT"), ("isc", "ISC"), ("terms:permissive", "ISC")]
    assert {f.label for f in by_id[9]} == {"mit", "gpl", "terms:permissive", "cc-by"}
    assert by_id[11] == []


def test_query_equals_loop(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = queries.op12_license_scan(spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, n_base, first, last, labels, notices = brute(docs[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, n_base, first, last, labels)
        assert notices <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")
