"""Spark rows against DuckDB rows: same columns, same values, in any order."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def connect(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def cells(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        if hasattr(v, "__len__") and not isinstance(v, str):
            return str(list(v))
        return repr(float(v)) if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(one, r)) for r in df.itertuples(index=False))


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    a, b = cells(got), cells(want)
    assert len(a) == len(b)
    assert a == b, f"only here {sorted(set(a) - set(b))[:3]}, only there {sorted(set(b) - set(a))[:3]}"
