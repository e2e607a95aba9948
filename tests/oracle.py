"""Spark results against DuckDB, column by column and row by row in any order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return str(v) if hasattr(v, "isoformat") else v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=str)


def duck(sql, d=DATA):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{d}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    got = con.sql(sql)
    return sorted(got.columns), rows(got.columns, got.fetchall())


def spark_rows(df):
    return sorted(df.columns), rows(df.columns, df.collect())
