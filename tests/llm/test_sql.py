"""The SQL of the operators' queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from panolith.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df, want = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(want.select(*[f'"{c}"' for c in cols]).fetchall())
