"""Every contract query against its SQL, at the smallest scale."""

import datetime
import decimal
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidemill import contract, contract_loads  # noqa: F401

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (decimal.Decimal, float)):
        return round(float(v), 6)
    return v.isoformat() if isinstance(v, (datetime.datetime, datetime.date)) else v


@pytest.mark.parametrize("name", sorted(contract.SQL))
def test_same_rows(spark, duck, name):
    got = contract.QUERIES[name](spark, str(DATA))
    want = duck.sql(contract.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    a = Counter(tuple(plain(r[c]) for c in order) for r in got.collect())
    at = [want.columns.index(c) for c in order]
    b = Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert a == b


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
