"""The queries that have a DuckDB twin, against it."""

import duckdb
import pytest

from waymark.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{FOLDER}/documents.parquet')")
    cursor = con.execute(queries.oracle_sql()[name])
    there = [d[0] for d in cursor.description]
    df = queries.queries()[name](spark, FOLDER)
    assert sorted(there) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*there).collect()) == sorted(cursor.fetchall())
