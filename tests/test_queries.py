from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from lodeseek.plans import catalog


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    import datetime

    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, sf, con, name):
    cur = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    df = catalog.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(plain(v) for v in r) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr) == want


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_flagship(spark, sf):
    assert catalog.flagship(spark, sf).count() > 0
