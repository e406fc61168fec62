import importlib
import sys


def test_queries_and_sql_have_names_in_common():
    from corpusmill.plans import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES) and len(ORACLES) > 80


def test_entry_imports_without_the_pipeline(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    for name in [n for n in sys.modules if n.startswith("corpusmill.llm")]:
        monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.setitem(sys.modules, "corpusmill.llm", None)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert "curated_documents" in entry.queries() and "pipeline" not in entry.queries()
    sys.modules.pop("__spark_entry__", None)
