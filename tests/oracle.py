"""Runs a query's SQL in DuckDB and compares values."""

import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(v[i]) for i in order) for v in values)


def same(spark, folder: str, query, sql: str) -> None:
    df = query(spark, folder)
    rel = connect(folder).sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())
