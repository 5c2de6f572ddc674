import duckdb
import pytest

from blockweave.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    names = sorted(got.columns)
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == names
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got.select(*names).collect()), key=key) == sorted(want.select(*names).fetchall(), key=key)
