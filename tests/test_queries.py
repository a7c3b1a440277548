import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from seqlattice.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{v:.5f}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = duck.sql(ORACLES[name])
    assert sorted(got.columns) == cols
    want = got.select(*(duckdb.ColumnExpression(c) for c in cols)).fetchall()
    assert plain(map(tuple, df.select(*(f"`{c}`" for c in cols)).collect())) == plain(want)


def test_entry_points(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if DATA.exists():
        assert not entry.entry(spark).isEmpty()
