"""The driver's entry works with and without the training-data operators."""

import importlib
import sys


def _fresh(monkeypatch, missing):
    for name in [m for m in sys.modules if m == "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name)
    for name in missing:
        monkeypatch.setitem(sys.modules, name, None)
    return importlib.import_module("__spark_entry__")


def test_entry_without_the_optional_package(monkeypatch):
    entry = _fresh(monkeypatch, ["corpus_pipeline", "tabsense.llm"])
    names = entry.queries()
    assert "quality_scorecard" in names and not [n for n in names if n.startswith("op") or n == "pipeline"]
    assert set(entry.oracle_sql()) <= set(names)
