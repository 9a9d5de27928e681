"""Every relational query against its SQL in DuckDB, at the smallest scale."""

import math

import duckdb
import pytest

from metrolith.plans.operator_queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 3) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in ORACLE_SQL:
        assert df.columns
        return
    found = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    expected = [tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, expected))


def test_places_of_the_sql(spark, duck):
    """What the SQL rounds to six places is not cut to four."""
    name = "correlate_spearman_many_groups"
    assert QUERIES[name](spark, SF).first()[0] == pytest.approx(duck.execute(ORACLE_SQL[name]).fetchone()[0], abs=2e-6)
