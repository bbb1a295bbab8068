"""Compares a query with its SQL: columns by name, rows as a multiset."""

from __future__ import annotations

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda x: round(x, 6) if isinstance(x, float) else tuple(map(cell, x)) if isinstance(x, list | tuple) else x
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def same(df, sql: str, sf_dir: str) -> tuple[int, int, bool]:
    got = connect(sf_dir).execute(sql)
    names = [d[0] for d in got.description]
    a, b = normal([tuple(r) for r in df.collect()], df.columns), normal(got.fetchall(), names)
    return len(a), len(b), sorted(df.columns) == sorted(names) and a == b
