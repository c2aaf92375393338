"""Runs a registered query and its SQL and compares the rows."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def _frame(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        if hasattr(x, "item"):
            x = x.item()
        if isinstance(x, float):
            return round(x, 6) + 0.0
        return x

    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


def differences(spark, con, query, sql: str, sf_dir: str) -> str:
    ours, theirs = query(spark, sf_dir), con.sql(sql)
    kinds = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}
    own = {c: kinds.get(k, k) for c, k in ours.dtypes}
    other = dict(zip(theirs.columns, map(str, theirs.types)))
    if own != other:
        return f"columns {own} and {other}"
    a, b = _frame(ours.toPandas()), _frame(theirs.df())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, such as {bad[0]}" if bad else ""
