"""Compare a query's rows with those of its SQL, the way the driver does."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def ordered(names, rows):
    place = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in place) for r in rows]
    return sorted(names), sorted(out, key=repr)


def differences(df, con, sql: str) -> list[str]:
    """What differs between a Spark result and an SQL result; empty if nothing does."""
    names, rows = ordered(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    sql_names = [d[0] for d in result.description]
    other_names, other = ordered(sql_names, result.fetchall())
    if names != other_names:
        return [f"columns {names} / {other_names}"]
    if len(rows) != len(other):
        return [f"{len(rows)} rows / {len(other)}"]
    spark_types = {n: t for n, t in df.dtypes}
    sql_types = dict(zip(sql_names, [str(d[1]) for d in con.execute(
        f"select * from ({sql}) limit 0").description]))
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
            "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    wrong = [f"type of {n}: {spark_types[n]} / {sql_types[n]}" for n in names
             if same.get(spark_types[n]) != sql_types[n]]
    odd = [(a, b) for a, b in zip(rows, other) if a != b]
    return wrong + ([f"{len(odd)} rows differ, first {odd[0][0]} / {odd[0][1]}"] if odd else [])
