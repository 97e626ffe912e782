"""Every core query with SQL gives the same rows as DuckDB; the others run and keep their schema."""

import math
from pathlib import Path

import duckdb
import pytest

from tidemill.queries import ORACLES, QUERIES


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for file in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(_plain(r[c]) for c in columns)) for r in df.collect())
    if name not in ORACLES:
        return
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert rows == sorted(repr(tuple(_plain(r[i]) for i in place)) for r in result.fetchall())
