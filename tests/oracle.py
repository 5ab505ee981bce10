"""Runs a query and its DuckDB SQL over the same tables and compares the rows, whatever their order."""

import datetime
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float) and x.is_integer():
        return int(x)
    return str(x) if isinstance(x, (pd.Timestamp, datetime.date)) else x


def rows(df, columns):
    return sorted(repr(tuple(map(_value, r))) for r in df[columns].astype(object).itertuples(index=False))


def same(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    a, b = df.toArrow().to_pandas(integer_object_nulls=True), con.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)
    assert rows(a, columns) == rows(b, columns)
