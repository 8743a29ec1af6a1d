"""Rows of a query against DuckDB SQL over the same Parquet files."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def duckdb_rows(sql, folder):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    return [dict(zip(names, row, strict=True)) for row in done.fetchall()]


def assert_same(df, sql, folder):
    columns = sorted(df.columns)
    expected = duckdb_rows(sql, folder)
    if expected:
        assert sorted(expected[0]) == columns
    key = lambda row: tuple(repr(normal(row[c])) for c in columns)
    assert sorted(map(key, (r.asDict() for r in df.collect()))) == sorted(map(key, expected))
