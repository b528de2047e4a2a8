"""The queries that SQL can express, against their SQL in DuckDB."""

import duckdb
import pytest

from tessera.llm import queries as q

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_is_the_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = q.queries()[name](spark, SF).toPandas()
    want = con.sql(q.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want) > 0
    for c in columns:
        assert got[c].equals(want[c].astype(got[c].dtype)), c
