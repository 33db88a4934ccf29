"""Every query that has SQL is held against DuckDB on the same tables, as multisets of rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
import pytest

from trialspark.plans.catalog import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else float(v)
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    r = duck.execute(ORACLE[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(row[names.index(c)]) for c in columns) for row in r.fetchall()), key=repr)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 2e-6 * max(1, abs(x))), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_streams_end_where_batches_do(spark, sf):
    live, batch = (sorted(map(tuple, QUERIES[n](spark, sf).collect())) for n in ("x3_liveness", "x3_liveness_batch"))
    assert live == batch and live
    windows = {r["start"].replace(tzinfo=None): (r["n"], r["bad"]) for r in QUERIES["x4_windowed_incidence_stream"](spark, sf).collect()}
    whole = {r["start"]: (r["n"], r["bad"]) for r in QUERIES["x4_windowed_incidence"](spark, sf).collect()}
    assert windows and all(whole[k] == v for k, v in windows.items())  # the last windows stay open behind the watermark
