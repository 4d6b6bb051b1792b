"""Compares a query's rows with its SQL's on the same tables: columns by name, rows in any order, numbers to 9 digits."""

import datetime as dt
import glob
import math
import os

import duckdb


def connection(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (dt.date, dt.datetime)):
        return str(v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def differences(df, con, sql: str) -> str:
    """Empty if equal, else what differs first."""
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.sql(sql)
    wanted_names, wanted = rows_of(found.columns, found.fetchall())
    if names != wanted_names:
        return f"columns {names} {wanted_names}"
    if len(got) != len(wanted):
        return f"{len(got)} rows, {len(wanted)} by SQL"
    bad = [(g, w) for g, w in zip(got, wanted) if g != w]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""
