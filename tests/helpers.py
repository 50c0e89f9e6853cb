"""Comparing a query with DuckDB."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def connect(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def text(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([text(x) for x in v])
    if pd.isna(v):
        return "~"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (float, np.floating)):
        return "0" if v == 0 else f"{v:.9g}"
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(text(v) for v in r) for r in df.itertuples(index=False))


def same(query, sql, spark, sf_dir, connection=None):
    a = query(spark, sf_dir).toPandas()
    b = (connection or connect(sf_dir)).sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
