"""The queries of the driver contract."""

import importlib
import sys

import pytest


def test_a_module_that_cannot_be_imported_is_an_error(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("quirespark.llm")] + ["__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name, raising=False)
    monkeypatch.setitem(sys.modules, "regex", None)
    monkeypatch.delattr("quirespark.llm", raising=False)
    with pytest.raises(ImportError):
        importlib.import_module("__spark_entry__")
