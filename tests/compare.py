"""A query's rows against those of its SQL, in any order."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb
import pandas as pd


def oracle(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'; SET threads = 4")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    cursor = con.execute(sql)
    return pd.DataFrame(cursor.fetchall(), columns=[d[0] for d in cursor.description])


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)) or x is pd.NaT:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float, decimal.Decimal)) or hasattr(x, "item"):
        return float(f"{float(x):.9g}")
    if isinstance(x, (pd.Timestamp, datetime.datetime)):
        return pd.Timestamp(x).tz_localize(None).isoformat()
    return x


def rows(records, columns: list[str]) -> list[tuple]:
    names = sorted(columns)
    at = [columns.index(c) for c in names]
    return sorted((tuple(plain(r[i]) for i in at) for r in records), key=repr)


def same(df, sf_dir: str, sql: str) -> None:
    want = oracle(sf_dir, sql)
    assert sorted(df.columns) == sorted(want.columns)
    got, expected = rows([tuple(r) for r in df.collect()], df.columns), rows(want.astype(object).itertuples(index=False, name=None), list(want.columns))
    assert len(got) == len(expected), (len(got), len(expected))
    for g, e in zip(got, expected, strict=True):
        assert g == e, (sorted(df.columns), g, e)
