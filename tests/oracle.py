"""Runs a registered query and its SQL over the same tables and compares their rows."""

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        files = glob.glob(f"{path}/*.parquet") if os.path.isdir(path) else [path]
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({files!r})")
    return con


def normal(row):
    return tuple((round(v, 4) + 0.0 if not math.isnan(v) else "nan") if isinstance(v, float) else v for v in row)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((normal([r[i] for i in order]) for r in rows), key=repr)


def assert_same(df, sql: str, sf_dir: str) -> None:
    found = connection(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(found.columns, found.fetchall())
