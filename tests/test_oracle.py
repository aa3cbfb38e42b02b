"""Queries against their SQL twins: one in four by default and those outside the core, all of them with FULL_ORACLE=1."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from forewarn.catalog import QUERIES as CORE

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
NAMES = sorted(ORACLE)
if not os.environ.get("FULL_ORACLE"):
    NAMES = sorted({*NAMES[::4], *(set(NAMES) - set(CORE))})


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for path in sorted(glob.glob(f"{sf}/*.parquet")):
        c.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return c


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    return (2, repr(v + 0)) if isinstance(v, (int, float)) else (3, str(v))


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES) and len(ORACLE) > 150


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    cur = con.execute(ORACLE[name])
    at = {d[0]: i for i, d in enumerate(cur.description)}
    assert sorted(at) == cols
    want = sorted(tuple(norm(r[at[c]]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_entry(spark):
    assert [r.band for r in entry.entry(spark).collect()] and len(entry.entry(spark).columns) == 4
