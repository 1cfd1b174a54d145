"""Compare a registered query with its SQL on DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None:
        return "<null>"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        number = float(value)
        return "nan" if math.isnan(number) else repr(number)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted([_plain(r[n]) for n in names] for r in df.collect())


def rows_of_sql(con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    names = sorted(columns)
    order = [columns.index(n) for n in names]
    return names, sorted([_plain(r[i]) for i in order] for r in cursor.fetchall())


def difference(df, con, sql) -> str | None:
    """None when equal, else a short account of the difference."""
    names, got = rows_of_spark(df)
    wanted_names, wanted = rows_of_sql(con, sql)
    if names != wanted_names:
        return f"columns {names} != {wanted_names}"
    if len(got) != len(wanted):
        extra = [r for r in got if r not in wanted][:2] if len(got) < 5000 else []
        return f"rows {len(got)} != {len(wanted)} {extra} first {got[:1]} {wanted[:1]}"
    for a, b in zip(got, wanted):
        if a != b:
            shown = {n: (x[:200], y[:200]) for n, x, y in zip(names, a, b) if x != y}
            return f"values differ: {shown}"
    return None
