"""Comparison of a query with its SQL over one folder of tables."""

import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def tables(folder=DATA):
    con = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _cell(v):
    v = v.tolist() if hasattr(v, "tolist") else v
    if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)):
        return None
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(([_cell(v) for v in r] for r in frame.itertuples(index=False)), key=str)


def same(spark, con, query, sql, folder=DATA):
    assert rows(query(spark, folder).toPandas()) == rows(con.execute(sql).df())
