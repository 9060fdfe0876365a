"""Runs a query and its SQL on the same tables and compares rows without order."""

import glob
import os

import duckdb
import pandas as pd


def views(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float):
        return f"{v:.8g}"
    return v.isoformat()[:10] if hasattr(v, "isoformat") else str(v).lower() if isinstance(v, bool) else str(v)


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(_cell, r)) for r in df.itertuples(index=False))


def assert_same(spark, sf_dir, query, sql):
    ours, theirs = query(spark, sf_dir).toPandas(), views(sf_dir).execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = rows(ours), rows(theirs)
    assert len(a) == len(b)
    assert a == b, [x for x in zip(a, b, strict=True) if x[0] != x[1]][:3]
