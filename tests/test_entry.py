"""Every query against its DuckDB equivalent on the smallest tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MEDIA = entry._media()
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return repr(round(float(v), 9) + 0.0) if isinstance(v, (int, float)) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


@pytest.mark.parametrize("name", sorted(MEDIA.QUERIES))
def test_query(spark, duck, name):
    df = MEDIA.QUERIES[name](spark, SMALL)
    got = rows(df.columns, df.collect())
    if name in MEDIA.ORACLE_SQL:
        q = duck.sql(MEDIA.ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(q.columns)
        assert got == rows(q.columns, q.fetchall())


def test_oracles_are_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
