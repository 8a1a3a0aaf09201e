"""Comparison of a query with its SQL on the same tables."""

import glob
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connect():
    db = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        inner = f"{path}/*.parquet" if os.path.isdir(path) else path
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{inner}'")
    return db


def compare(spark, query, sql):
    got, want = query(spark, DATA).toPandas(), connect().sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)

    def rows(frame):
        plain = frame[columns].astype(object)
        return sorted(map(str, plain.where(plain.notna(), None).itertuples(index=False, name=None)))

    assert rows(got) == rows(want)
