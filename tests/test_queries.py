"""Every registered library query with SQL against DuckDB on the smallest tables; streams against batches."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from echotable import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(value(x) for x in v)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sql, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(value(r[c]) for c in cols)) for r in df.collect())
    if name not in plans.ORACLES:
        assert got
        return
    cur = sql.execute(plans.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(value(dict(zip(names, r))[c]) for c in cols)) for r in cur.fetchall())
    assert got == want


def test_stream_confirmation_equals_batch(spark):
    from pyspark.sql import functions as F

    from echotable.operators import ordered as O
    from echotable.sources import domain as D

    stream = plans.QUERIES["t3_stream_confirmation"](spark, SF).select(F.col("key").alias("event_id"), "consecutive", "confirmed", "newly_confirmed")
    e = D.table(spark, SF, "events").select("user_id", "event_id", "ts", "event_type", (F.col("event_id") % 4 != 0).alias("ok"))
    batch = O.confirm_repeats(e, "user_id", "ts", "event_type", "ok", "event_id", 2, 86_400).select(stream.columns)
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))
