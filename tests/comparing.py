"""Compares a query's rows with those of its oracle."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd


def _plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, int | float | np.integer | np.floating):
        return round(float(v), 6)
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(map(_plain, v))
    return str(v)


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(map(_plain, r))) for r in df.itertuples(index=False))


def oracle(sql: str, folder: str) -> pd.DataFrame:
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.sql(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    return c.sql(sql).df()
