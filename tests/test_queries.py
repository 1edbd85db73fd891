"""Every query against its SQL on the smallest tables; those without SQL must run with stable columns."""

import glob
import math
import os

import duckdb
import pytest

from litmesh import queries as Q

QUERIES, SQL = Q.queries(), Q.oracle_sql()


@pytest.fixture(scope="session")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 5)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    if name in SQL:
        rel = con.execute(SQL[name])
        names = [x[0] for x in rel.description]
        assert sorted(names) == cols
        assert got == sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in rel.fetchall())


def test_entry(spark):
    assert Q.entry(spark, "/root/testdata/sf0.001").count() > 0
