"""Spark result against SQL result, independent of row and column order."""

from __future__ import annotations

import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for table in TABLES:
        if os.path.exists(f"{sf_dir}/{table}.parquet"):
            con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def rows_of(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return rows_of(df.columns, df.collect())


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def spark_types(df) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema}


SAME = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date",
    "DOUBLE": "double", "TIMESTAMP": "timestamp_ntz",
}


def sql_types(con, sql: str) -> dict[str, str]:
    described = con.execute(f"describe {sql}").fetchall()
    return {r[0]: SAME.get(r[1], r[1]) for r in described}
