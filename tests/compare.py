"""Run registered queries against their SQL on the same Parquet files."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def sql_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        if glob.glob(f"{sf_dir}/{table}.parquet"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(sf_dir, table)}.parquet'")
    return con


def _cell(value):
    """Strict form: type matters, negative zero does not."""
    if value is None:
        return ("null", "")
    if isinstance(value, bool):
        return ("bool", str(value))
    if isinstance(value, int):
        return ("int", str(value))
    if isinstance(value, float):
        return ("nan", "") if math.isnan(value) else ("float", repr(value + 0.0))
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, (datetime.date, datetime.datetime)):
        return ("time", value.isoformat())
    return (type(value).__name__, str(value))


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(df, con, sql) -> str | None:
    got_columns, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want_columns, want = canonical([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; first: {got[:2]} / {want[:2]}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        pairs = [[(c, a, b) for c, a, b in zip(got_columns, g, w) if a != b] for g, w in wrong[:3]]
        return f"{len(wrong)} of {len(got)} rows differ, e.g. {pairs}"
    return None
