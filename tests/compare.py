"""Result comparison between Spark and DuckDB, independent of row and column order."""

from __future__ import annotations

import datetime as dt
import decimal
import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        value = round(value, 6)
        return int(value) if value == int(value) else value
    if isinstance(value, dt.datetime) and value.time() == dt.time():
        return value.date()
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = [tuple(plain(row[i]) for i in order) for row in rows]
    body.sort(key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))
    return [columns[i] for i in order], body


def spark_table(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def duckdb_table(con, sql):
    found = con.execute(sql)
    return table([d[0] for d in found.description], found.fetchall())
