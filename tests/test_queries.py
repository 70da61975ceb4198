"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import collections

import duckdb
import pandas as pd
import pytest

from scanloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def rows(df, cols):
    def plain(v):
        if v is None or (not isinstance(v, (str, list)) and pd.isna(v)):
            return None
        return v if isinstance(v, str) else round(float(v), 6)

    return collections.Counter(tuple(plain(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_as_sql(spark, con, small, name):
    got, want = registry.QUERIES[name](spark, small).toPandas(), con.sql(registry.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert rows(got, cols) == rows(want, cols)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - {"cg_map"}))
def test_runs(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0
