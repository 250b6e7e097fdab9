"""The numbered queries against DuckDB over the smallest tables, where SQL can express them."""

import pytest

from tests.test_queries import DATA, compared, duck, pytestmark  # noqa: F401
from tracelake.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_same_as_sql(spark, duck, name):  # noqa: F811
    compared(spark, duck, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_runs_over_whole_tables(spark, name):
    df = QUERIES[name](spark, DATA)
    ids = {r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in df.select("doc_id").collect()} == ids
