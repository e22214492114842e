import ast
import importlib.util
import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_nothing_else_imports_the_training_data_operators():
    for folder, _, files in os.walk(os.path.join(ROOT, "filigree")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                tree = ast.parse(open(os.path.join(folder, f), encoding="utf-8").read())
                names = [n.module or "" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)] + [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names]
                assert not [n for n in names if n.startswith("filigree.llm")], f


def test_entry_without_that_subpackage(monkeypatch):
    import __spark_entry__ as e

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a: None if n.startswith("filigree.llm") or n == "corpus_pipeline" else real(n, *a))
    assert "metrics_long" in e.queries() and "pipeline" not in e.queries() and not [k for k in e.queries() if k.startswith("op")]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert "filigree.plans.queries" in sys.modules
