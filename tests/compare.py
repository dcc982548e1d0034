"""Comparing a Spark result with DuckDB's, whatever the order of rows and columns."""

import math
from pathlib import Path

import duckdb


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, list):
        return tuple(map(_norm, v))
    return v


def connect(folder: str):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def rows_of(df):
    return sorted((tuple(map(_norm, r)) for r in df.select(*[f"`{c}`" for c in sorted(df.columns)]).collect()), key=repr)


def sql_rows(con, sql):
    got = con.execute(sql)
    order = sorted(range(len(got.description)), key=lambda i: got.description[i][0])
    names = sorted(c[0] for c in got.description)
    return names, sorted((tuple(_norm(r[i]) for i in order) for r in got.fetchall()), key=repr)
