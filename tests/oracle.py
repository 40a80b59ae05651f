"""Compares a query's rows with its SQL in DuckDB, without regard to order."""

import math
import os

import duckdb
import numpy as np
import pandas as pd


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        return None if math.isnan(v) else round(float(v), 6)
    if isinstance(v, (int, np.integer)):
        return int(v)
    return str(v)


def rows(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(plain(x) for x in r) for r in df.itertuples(index=False)), key=repr)


def database(sf_dir: str):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


def check(query, sql: str, spark, sf_dir: str):
    got, want = rows(query(spark, sf_dir).toPandas()), rows(database(sf_dir).sql(sql).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
