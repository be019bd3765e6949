"""The registered queries at the smallest scale, against DuckDB."""

import os
import shutil
import subprocess
import sys

import pytest

duckdb = pytest.importorskip("duckdb")

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracles import TABLES, table_of  # noqa: E402

from tabwise.plans.oracles import all_oracles  # noqa: E402
from tabwise.plans.queries import all_queries  # noqa: E402

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are absent")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return connection


def test_every_query_has_sql():
    """The library's own queries; those of the optional subpackage have their own tests."""
    assert set(all_queries()) == set(all_oracles())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SMALL)
    got = table_of(df.columns, df.collect())
    cursor = db.execute(entry.oracle_sql()[name])
    assert got == table_of([d[0] for d in cursor.description], cursor.fetchall())


def test_entry_without_the_subpackage(tmp_path):
    """A tree without the optional folders still imports and keeps the library's queries."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "tabwise"), tmp_path / "tabwise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for keep_pipeline in (True, False):
        place = tmp_path / ("with" if keep_pipeline else "without")
        place.mkdir()
        shutil.copytree(tmp_path / "tabwise", place / "tabwise")
        for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * keep_pipeline:
            if os.path.exists(os.path.join(root, name)):
                shutil.copy(os.path.join(root, name), place / name)
        code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), set(e.oracle_sql()) == set(e.queries()))"
        path = os.pathsep.join(p for p in sys.path if p and os.path.abspath(p) != root)
        done = subprocess.run([sys.executable, "-c", code], cwd=place, env=os.environ | {"PYTHONPATH": path}, capture_output=True, text=True, check=True)
        assert done.stdout.split() == [str(len(all_queries())), "False", "True"]
