import importlib
import os
import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
import duckdb
import pytest
from gridlens import catalog

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return c


def key(rows):
    return sorted(tuple("null" if v is None or v != v else v for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_catalogue_equals_sql(spark, con, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = df.toPandas()
    want = con.execute(catalog.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert key(got[columns].astype(object).values.tolist()) == key(want[columns].astype(object).values.tolist())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r.line.startswith("| ") for r in rows)


def test_works_without_the_corpus_operators(tmp_path):
    """The driver deletes them: the entry must still import and offer the rest."""
    for p in (ROOT / "gridlens").rglob("*.py"):
        if "llm" not in p.parts:
            to = tmp_path / p.relative_to(ROOT)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_bytes(p.read_bytes())
    (tmp_path / "__spark_entry__.py").write_bytes((ROOT / "__spark_entry__.py").read_bytes())
    code = "import __spark_entry__ as e; assert 'flagship' in e.queries() and 'flagship' in e.oracle_sql() and 'pipeline' not in e.queries()"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    run()
    # nor where something that they import is missing
    (tmp_path / "corpus_pipeline.py").write_text("import a_library_that_is_not_there\n")
    run()


def test_nothing_imports_the_corpus_operators():
    for p in (ROOT / "gridlens").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text())
    assert importlib.import_module("gridlens.api")
