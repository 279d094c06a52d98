"""Compares a query with its SQL, run by DuckDB over the same tables."""

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if isinstance(x, float):
        return round(x, 9)
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return str(x) if x.__class__.__name__ in ("Timestamp", "datetime", "Decimal") else x


def compare(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        at = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = Counter(tuple(_plain(r[i]) for i in order) for r in got.fetchall())
    have = Counter(tuple(_plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert have == want, (list((have - want).items())[:3], list((want - have).items())[:3])
    return sum(want.values())
