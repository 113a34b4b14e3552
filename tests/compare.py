"""Runs a query and its SQL over the same tables and compares names and rows, in any order."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def plain(v):
    if isinstance(v, float) and v != v or v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if hasattr(v, "tolist") and not hasattr(v, "isoformat"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def differences(spark_df, con, sql):
    """None if equal, else what differs."""
    got = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    want = rel.fetchall()
    if sorted(spark_df.columns) != sorted(rel.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(rel.columns)}"
    a, b = rows_of(spark_df.columns, got), rows_of(rel.columns, want)
    if len(a) != len(b):
        return f"rows {len(a)} and {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows, first {bad[0]}" if bad else None
