"""Compare a query with its SQL twin, row by row, ignoring order."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _norm(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_norm(v) for v in value)
    return value


def _key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=_key)


def compare(df, con, sql: str) -> tuple[list[str], int]:
    """Differences between a DataFrame and the SQL result (empty when equal), and the row count."""
    spark_cols, spark_rows = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    sql_cols, sql_rows = _rows(cols, cur.fetchall())
    if spark_cols != sql_cols:
        return [f"columns {spark_cols} != {sql_cols}"], len(spark_rows)
    if len(spark_rows) != len(sql_rows):
        return [f"row count {len(spark_rows)} != {len(sql_rows)}"] + [
            f"only spark {r}" for r in list(set(spark_rows) - set(sql_rows))[:3]
        ] + [f"only sql {r}" for r in list(set(sql_rows) - set(spark_rows))[:3]]
    out = []
    for a, b in zip(spark_rows, sql_rows):
        if a != b or [type(x) for x in a] != [type(y) for y in b]:
            out.append(f"{dict(zip(spark_cols, a))} != {dict(zip(sql_cols, b))}")
            if len(out) == 5:
                break
    return out, len(spark_rows)
