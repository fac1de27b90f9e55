"""Shared by the tests of this folder (not a conftest, whose name the folder above already has)."""

import pytest

from tabsense.llm.common import worker_path

SF_SMALL = "/root/testdata/sf0.001"
ODD_TEXTS = [None, "", " ", "\n\n\n", "a", "x" * 30_000, "word " * 5_000, "é" * 9_000, "<|endoftext|> and <|ENDOFTEXT|>it's we'LL",
             "tab\tfeed\x0bline  wide  spaces  twice", "éÉJ̌ İ Σς", "12 345,6!! ###", "\U0001f600 漢字"]


@pytest.fixture(autouse=True)
def _workers(spark):
    worker_path(spark)


@pytest.fixture
def odd_docs(spark):
    """Odd texts, a NULL id, repeated rows and columns whose names clash with results."""
    rows = [(i, t, "src", 7, 0.5, "x") for i, t in enumerate(ODD_TEXTS)] + [(None, "no id", "src", 7, 0.5, "x"), (4, "a", "src", 7, 0.5, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int, score double, tier string")
