"""Queries of training-data operators against their SQL equivalents in DuckDB."""

import duckdb
import pytest

from chronopanel.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    got = queries.queries()[name](spark, DATA)
    want = con.sql(queries.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = lambda found: sorted(([str(x) for x in r] for r in found), key=str)
    assert rows(got.select(*names).collect()) == rows(want.select(", ".join(names)).fetchall())
