"""Comparison of a query's rows with those of its SQL in DuckDB."""

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def compare(frame, sql, folder):
    columns = sorted(frame.columns)
    want = connect(folder).execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    found = [tuple(r[c] for c in columns) for r in frame.collect()]
    assert Counter(found) == Counter(want)
    return len(want)
