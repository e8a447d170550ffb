"""Every registered query of the library against its SQL on DuckDB, at the smallest scale."""

import datetime
import decimal
import math

import duckdb
import pytest

from crewlens import catalog

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float)):
        return "nan" if math.isnan(value) else repr(float(value) + 0.0)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(set(columns)) == len(columns)
        return
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert sorted([plain(r[names.index(c)]) for c in columns] for r in found.fetchall()) == got


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
