"""Every query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from lexigrid.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def plain(rows):
    return sorted(map(repr, rows))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sql.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert plain(map(tuple, df.select(*columns).collect())) == plain(found)
