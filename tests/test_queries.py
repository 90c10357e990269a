"""Every query against its SQL twin in DuckDB, over the smallest tables."""

import datetime
import math

import duckdb
import pytest

from certloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if type(v).__name__ == "Decimal":
        return repr(round(float(v), 6))
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else str(v)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, oracle, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in catalog.ORACLES:
        result = oracle.execute(catalog.ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    else:
        assert got
