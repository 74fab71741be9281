"""Runs a query and its DuckDB equivalent on the same tables and compares rows without their order."""

import decimal
import os

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql: str, data: str = DATA) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con.execute(sql).df()


def normal(df: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    df = df[sorted(df.columns)]

    def value(x):
        if x is None or x is pd.NA or x != x:
            return None
        if isinstance(x, (float, decimal.Decimal)):
            return round(float(x), 6)
        return x.item() if hasattr(x, "item") else str(x) if isinstance(x, pd.Timestamp) else x

    return list(df.columns), sorted((tuple(map(value, r)) for r in df.itertuples(index=False)), key=repr)


def same(spark, query, sql: str, data: str = DATA) -> None:
    got, want = normal(query(spark, data).toPandas()), normal(oracle(sql, data))
    assert got[0] == want[0]
    assert got[1] == want[1]
