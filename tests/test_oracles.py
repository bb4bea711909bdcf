"""Every query with SQL gives DuckDB's rows; the others have rows."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from tidewheel.plans import registry
from tidewheel.plans.relations import TABLES

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (int, float)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


@pytest.fixture(scope="module")
def duck():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, str(DATA))
    got = rows(df.columns, df.collect())
    if name in registry.ORACLES:
        ran = duck.execute(registry.ORACLES[name])
        assert got == rows([d[0] for d in ran.description], ran.fetchall())
    else:
        assert got[1]
