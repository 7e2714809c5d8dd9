"""Every registered query runs; those with SQL give the same rows in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from lociq.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    return round(float(v), 5) if isinstance(v, (int, float)) else str(v)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    rows = [r.asDict() for r in df.collect()]
    assert rows
    if name not in ORACLES:
        return
    rel = db.sql(ORACLES[name])
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert sorted(df.columns) == sorted(rel.columns)
    key = sorted(df.columns)
    mine, theirs = (sorted((tuple(plain(r[c]) for c in key) for r in x), key=str) for x in (rows, want))
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-5, abs_tol=2e-5)), (name, a, b)
