"""Runs a query and its SQL on the same tables and compares names and rows, whatever their order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def difference(spark, db, fn, sql, sf_dir):
    """None if equal, else what differs."""
    df = fn(spark, sf_dir)
    got = df.collect()
    cur = db.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)}, expected {sorted(names)}"
    a, b = rows_of(df.columns, [tuple(r) for r in got]), rows_of(names, cur.fetchall())
    if a == b:
        return None
    return f"{len(a)} rows, expected {len(b)}: {[x for x in zip(a, b) if x[0] != x[1]][:2]}"
