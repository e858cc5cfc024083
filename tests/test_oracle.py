"""Every query that has SQL gives DuckDB's rows on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from lorekeep.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, datetime.date):
        return str(x)
    return x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(map(plain, r)) for r in df.select(cols).collect())))
    if name in catalog.ORACLE_SQL:
        sql = f"select {', '.join(cols)} from ({catalog.ORACLE_SQL[name]})"
        assert got == sorted(map(repr, (tuple(map(plain, r)) for r in duck.sql(sql).fetchall())))
