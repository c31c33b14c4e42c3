"""The training-data queries that have SQL give what DuckDB gives."""

import glob
import os

import duckdb
import pytest

from strandweave.llm import catalog

Q, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, small, name):
    c = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW \"{os.path.basename(p)[:-8]}\" AS SELECT * FROM '{p}'")
    got, want = Q[name](spark, small).toPandas(), c.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and len(want)
    rows = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
