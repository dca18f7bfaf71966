"""Compares a query with its SQL in DuckDB over the same tables."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def _plain(x):
    if x is None or x is pd.NaT or x is pd.NA:
        return None
    if isinstance(x, (float, np.floating)):
        return None if x != x else round(float(x), 6)
    if isinstance(x, np.integer):
        return int(x)
    if isinstance(x, (list, np.ndarray)):
        return [_plain(y) for y in x]
    if isinstance(x, pd.Timestamp):
        return str(x.tz_localize(None) if x.tzinfo else x)
    return x


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([_plain(r[i]) for i in order]) for r in rows)


def assert_same(spark, name, query, sql):
    df = query(spark, DATA)
    rows = pd.DataFrame([r.asDict(True) for r in df.collect()], columns=df.columns)
    got = canonical(df.columns, rows.itertuples(index=False, name=None))
    r = connection().sql(sql)
    want = canonical(r.columns, pd.DataFrame(r.fetchall(), columns=r.columns).itertuples(index=False, name=None))
    assert got == want, name
