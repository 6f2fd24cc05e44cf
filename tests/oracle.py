"""Rows of a query in Spark and of its SQL in DuckDB, made comparable."""

import glob
import math
import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if getattr(v, "tzinfo", None) is not None:
        return v.replace(tzinfo=None)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def duck(directory, sql):
    con = duckdb.connect()
    for p in glob.glob(f"{directory}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}{'/*' if os.path.isdir(p) else ''}')")
    r = con.execute(sql)
    cols = [x[0] for x in r.description]
    return sorted(cols), rows(cols, r.fetchall())


def spark_rows(df):
    return sorted(df.columns), rows(df.columns, df.collect())
