import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_every_core_query_runs_and_names_match(spark):
    import duckdb

    from corpusloom.plans import queries

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in "events documents embeddings benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, f in queries.QUERIES.items():
        df = f(spark, sf)
        rows = df.count()
        if name in queries.SQL:
            cur = con.execute(queries.SQL[name])
            assert sorted(df.columns) == sorted(d[0] for d in cur.description), name
            assert rows == len(cur.fetchall()), name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_optional_subpackage(tmp_path):
    code = f"import sys; sys.path.insert(0, {str(ROOT)!r})\nimport importlib.abc\nclass No(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, *a):\n        if name in ('corpusloom.llm', 'corpus_pipeline'): raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert 'corpus_merge_dedupe' in e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries()), list(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_a_broken_subpackage_is_an_error(tmp_path):
    """Only the subpackage itself may be missing: an import that fails inside it is raised."""
    code = f"import sys; sys.path.insert(0, {str(ROOT)!r})\nimport importlib.abc\nclass No(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, *a):\n        if name == 'xxhash': raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, No())\ntry:\n    import __spark_entry__\nexcept ModuleNotFoundError as e:\n    assert e.name == 'xxhash'\nelse:\n    import importlib.util\n    assert importlib.util.find_spec('corpusloom.llm') is None"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
