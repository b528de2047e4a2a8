"""Every query of the library against its SQL oracle in DuckDB."""

import os

import duckdb
import pytest

from tessera.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    return df[sorted(df.columns)].sort_values(sorted(df.columns), kind="stable").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = rows(catalog.QUERIES[name](spark, SF).toPandas())
    if name not in catalog.ORACLES:
        assert list(got.columns)
        return
    want = rows(duck.sql(catalog.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got:
        assert got[c].equals(want[c].astype(got[c].dtype)), f"{name}: {c} differs"
