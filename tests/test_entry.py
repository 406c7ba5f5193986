import importlib
import sys


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    found = entry.entry(spark)
    assert found.columns == ["data_source", "prompt", "ability", "reward_model", "extra_info"] and found.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_optional_part(monkeypatch):
    for name in [n for n in sys.modules if n == "__spark_entry__" or n == "corpus_pipeline" or n.startswith("lodestar.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "lodestar.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert "split_random" in entry.queries() and "pipeline" not in entry.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__")
