"""Rows of a Spark query against rows of DuckDB SQL over the same tables."""

import duckdb
import pandas as pd

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return str([norm(x) for x in v])
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "None"
    if isinstance(v, float):
        return f"{v:.6f}".rstrip("0").rstrip(".")
    return norm(v.item()) if hasattr(v, "item") else str(v).replace(" 00:00:00", "")


def rows(df, columns):
    return sorted(tuple(norm(v) for v in r) for r in df[columns].astype(object).values.tolist())


def same(spark_df, sql, con):
    a, b = spark_df.toPandas(), con.sql(sql).df()
    assert set(a.columns) == set(b.columns)
    assert rows(a, list(a.columns)) == rows(b, list(a.columns))
