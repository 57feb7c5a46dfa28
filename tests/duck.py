"""Compares a query with its SQL on the same files."""

import decimal
import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return bytes(v) if isinstance(v, bytearray) else v


def both(df, sql, con):
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    there = [d[0] for d in cur.description]
    assert sorted(there) == names
    want = sorted((tuple(plain(r[there.index(n)]) for n in names) for r in cur.fetchall()), key=repr)
    return got, want
