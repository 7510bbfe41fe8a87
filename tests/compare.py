"""Rows of a query and of its SQL, as comparable text."""

import glob
import os

import duckdb


def normal(v):
    if isinstance(v, float):
        return repr(float(f"{v:.11g}") + 0.0)
    if isinstance(v, (list, tuple)):
        return str([normal(x) for x in v])
    if hasattr(v, "asDict"):
        v = v.asDict(True)
    if isinstance(v, dict):
        return str({k: normal(x) for k, x in v.items()})
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return repr(v)


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(str([normal(r[c]) for c in names]) for r in df.collect())


def sql_rows(folder, sql):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    at = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(str([normal(r[i]) for i in at]) for r in found.fetchall())
