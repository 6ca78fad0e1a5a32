"""Rows of a query and of its SQL, made comparable."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        given = f"{path}/*.parquet" if os.path.isdir(path) else path
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{given}'")
    return c


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql, sf_dir):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = connect(sf_dir).sql(sql)
    want = rows_of(result.columns, result.fetchall())
    assert sorted(df.columns) == sorted(result.columns)
    if got != want:
        one, other = set(got), set(want)
        only = [x for x in got if x not in other][:3], [x for x in want if x not in one][:3]
        raise AssertionError(f"{len(got)} and {len(want)} rows; only in one: {only}")
    return got
