from __future__ import annotations

import duckdb
import pytest

from lodeseek.llm.queries import queries
from lodeseek.llm.sql import oracle_sql


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, sf, name):
    from pathlib import Path

    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    cur = con.execute(oracle_sql()[name])
    columns = sorted(c[0] for c in cur.description)
    rows = [dict(zip([c[0] for c in cur.description], r, strict=True)) for r in cur.fetchall()]
    df = queries()[name](spark, sf)
    assert sorted(df.columns) == columns
    key = lambda r: tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in columns)
    assert sorted(map(key, df.collect())) == sorted(map(key, rows))


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, sf, name):
    assert queries()[name](spark, sf).count() > 0
