"""The same tables in DuckDB, and row-by-row comparison."""

import datetime as dt
import math
from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.001"


def tables(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of_spark(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted(tuple(plain(r[n]) for n in names) for r in df.collect())


def rows_of_duck(con, sql: str) -> tuple[list[str], list[tuple]]:
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in got.fetchall())
