"""Registered queries against their DuckDB texts on the smallest tables."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from blockloom import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_flagship(spark):
    assert len(entry.entry(spark).collect()) == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_optional_folder(tmp_path):
    """The entry point, its queries and the other tests stand alone where the llm folders and the pipeline are deleted."""
    root, copy = os.path.dirname(os.path.abspath(entry.__file__)), str(tmp_path / "copy")
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for gone in ("blockloom/llm", "tests/llm"):
        shutil.rmtree(f"{copy}/{gone}", ignore_errors=True)
    if os.path.exists(f"{copy}/corpus_pipeline.py"):
        os.remove(f"{copy}/corpus_pipeline.py")
    code = """
import __spark_entry__ as e
from blockloom import api, catalog, engine, local
from blockloom.functions import samples
assert set(e.queries()) == set(catalog.QUERIES) and set(e.oracle_sql()) == set(catalog.ORACLES)
"""
    env = os.environ | {"PYTHONPATH": copy}
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True, timeout=120)
    subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=copy, env=env, check=True, timeout=120, capture_output=True)


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    cell = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(cell(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = catalog.QUERIES[name](spark, DATA)
    rows = got.collect()
    if name not in catalog.ORACLES:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert plain(rows, got.columns) == plain(want.fetchall(), columns)
