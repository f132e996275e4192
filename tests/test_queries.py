"""Every query with SQL gives the same rows as the SQL on the smallest tables."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from lakewarden import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).iterdir():
        c.execute(f"CREATE VIEW {p.name.split('.')[0]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return repr(round(float(v), 4) + 0.0)
    if isinstance(v, datetime.datetime) and v.time() == datetime.time():
        v = v.date()
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in sorted(names)) for r in cur.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert got == want
