import importlib
import sys

import __spark_entry__ as entry


def test_names_and_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and {"p1_found", "recall_text", "bm25_scores"} <= set(sql)


def test_without_the_optional_part(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("mnemos.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "mnemos.llm", None)
    assert not any(q.startswith("p2_") for q in importlib.reload(entry).queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
