import sys

import __spark_entry__ as entry


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and "p4_found" in q and len(q) > 150


def test_core_does_not_need_the_training_data_operators():
    import ast
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "gistmap"
    for f in root.rglob("*.py"):
        if "llm" in f.relative_to(root).parts:
            continue
        for n in ast.walk(ast.parse(f.read_text())):
            names = [a.name for a in n.names] if isinstance(n, ast.Import) else [n.module or ""] if isinstance(n, ast.ImportFrom) else []
            assert not any(".llm" in x for x in names), f


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.limit(5).count() > 0
    assert sys.modules["__spark_entry__"] is entry
