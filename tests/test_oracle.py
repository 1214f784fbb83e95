"""Every query of the engine against its DuckDB twin on the smallest tables."""

import decimal

import duckdb
import pytest

from waymark import plans

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v) if v != int(v) else int(v)
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(v)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_its_twin(spark, duck, name):
    df = plans.QUERIES[name](spark, FOLDER)
    cursor = duck.execute(plans.SQL[name])
    there = [d[0] for d in cursor.description]
    assert sorted(there) == sorted(df.columns)
    want = sorted(tuple(plain(r[there.index(c)]) for c in df.columns) for r in cursor.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == want


def test_sequential_queries_have_a_row_for_each_request(spark):
    assert plans.QUERIES["admission"](spark, FOLDER).count() == 1000
    assert plans.QUERIES["fuzzy_names"](spark, FOLDER).columns == ["id", "id_r", "how"]
