"""Runs a query and its SQL over the same tables and compares the rows."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (np.integer, np.bool_, bool)):
        return float(int(v))
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    return pd.Timestamp(v).isoformat() if hasattr(v, "isoformat") else v


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False)), key=repr)


def tables(folder):
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def check(spark, folder, query, sql):
    got = rows(query(spark, folder).toPandas())
    if sql is not None:
        assert got == rows(tables(folder).sql(sql).df())
    return got
