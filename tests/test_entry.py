import importlib
import sys

import __spark_entry__


def test_registry():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["pattern", "path", "display", "line", "text"] and df.count() > 0


def test_without_the_pipeline(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    alone = importlib.reload(__spark_entry__)
    assert "find_lines" in alone.queries() and "pipeline" not in alone.queries() and alone.oracle_sql()
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
