"""Corpus queries against their SQL in DuckDB, at the smallest scale."""

import duckdb
import pytest

from metrolith.llm.oracles import ORACLE_SQL
from metrolith.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    df = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall())
    assert sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect()) == expected
