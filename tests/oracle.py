"""Compares a query with its SQL: column names, number of rows and values, whatever the order."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, f, sql) -> str:
    df = f(spark, sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    one, two = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, cur.fetchall())
    if one[0] != two[0]:
        return f"columns {one[0]} and {two[0]}"
    if len(one[1]) != len(two[1]):
        return f"{len(one[1])} and {len(two[1])} rows"
    bad = [(a, b) for a, b in zip(one[1], two[1], strict=True) if a != b]
    return f"{len(bad)} rows differ: {bad[:2]}" if bad else ""
