"""Side-by-side run of a query and its SQL twin."""

import os

import duckdb
import pandas as pd

DATA = "/root/testdata/sf0.001"


def connection():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


def _plain(x):
    if hasattr(x, "tolist") and getattr(x, "ndim", 0):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return str([_plain(y) for y in x])
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "NULL"
    return repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x)


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(tuple(_plain(x) for x in r) for r in df.astype(object).itertuples(index=False))


def same(spark, query, sql) -> None:
    got, want = query(spark, DATA).toPandas(), connection().execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
