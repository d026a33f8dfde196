"""The entry module: every query runs, and it works without the subpackage llm."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from quillon.plans.registered import ORACLE, QUERIES
from tests.conftest import ROOT, SMALL


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(float(v), 6) if isinstance(v, float) else v
    return [columns[i] for i in order], sorted((tuple(clean(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    df = QUERIES[name](spark, SMALL)
    got = rows(df.columns, df.collect())
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    cursor = con.execute(ORACLE[name])
    assert got == rows([c[0] for c in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_llm(tmp_path):
    for p in ("__spark_entry__.py", "quillon"):
        source = os.path.join(ROOT, p)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / p)
    shutil.rmtree(tmp_path / "quillon" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'control_status' in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
