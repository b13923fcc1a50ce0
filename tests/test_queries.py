"""Every registered panel query against its SQL equivalent in DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from chronopanel.plans import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def normal(df: pd.DataFrame) -> list:
    def value(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return None
        if hasattr(v, "year"):
            return str(v)[:10]
        return str(v) if isinstance(v, (bool, str)) or type(v).__name__ == "bool" else round(float(v), 5)

    rows = [tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in queries.SQL:
        want = duck.execute(queries.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        a, b = normal(got), normal(want)
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            assert x == pytest.approx(y, abs=2e-5, nan_ok=True) if all(isinstance(v, float) for v in x) else all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) < 2e-4) for p, q in zip(x, y, strict=True))
