"""DuckDB as the reference for queries with SQL."""

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype) in ("Int64", "Int32", "Float64"):
            df[c] = df[c].astype("float64")
        df[c] = df[c].astype("float64").round(6) + 0.0 if df[c].dtype.kind in "fiu" else df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def same(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    a, b = plain(a), plain(b)
    if list(a.columns) != list(b.columns) or len(a) != len(b):
        return False
    return all(np.allclose(a[c], b[c], atol=2e-6, equal_nan=True) if a[c].dtype.kind == "f" and b[c].dtype.kind == "f" else (a[c] == b[c]).all() for c in a.columns)
