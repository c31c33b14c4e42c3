"""Every core query with SQL gives what DuckDB gives; the others run."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from strandweave import catalog

Q, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW \"{os.path.basename(p)[:-8]}\" AS SELECT * FROM '{p}'")
    return c


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(repr([round(v, 6) + 0.0 if isinstance(v, float) else v for v in r]) for r in df.where(df.notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, duck, small, name):
    got = Q[name](spark, small).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert list(got.columns)


def test_flagship(spark, small):
    assert catalog.flagship(spark, small).count() > 0
