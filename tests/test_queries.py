"""Every query with SQL against DuckDB over the smallest tables; an entry point that survives without the llm folders."""

import math
import os
import re
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tracelake.plans import catalogue

DATA = "/root/testdata/sf0.001"
#: Queries that put single rows side by side.
ONE_ROW = {"dup_rate", "gap_report"}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6)
    return value if isinstance(value, (bool, int, str)) else str(value)


def compared(spark, duck, query, sql):
    df = query(spark, DATA)
    cols = sorted(df.columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert query.__name__ in ONE_ROW or not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[k]) for k in at) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", list(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    compared(spark, duck, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_llm(tmp_path):
    root = Path(entry.__file__).parent
    for p in root.iterdir():
        if p.name not in (".git", "corpus_pipeline.py", "tracelake", "tests"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "tracelake").mkdir()
    for p in (root / "tracelake").iterdir():
        if p.name != "llm":
            (tmp_path / "tracelake" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
