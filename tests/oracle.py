"""Runs a query and its SQL on the same tables and compares the rows, whatever their order."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else int(value) if value.is_integer() else float(f"{value:.10g}")
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def compare(df, con, sql: str) -> str:
    """Empty if the rows agree, else what differs."""
    own_names, own = rows(df.columns, df.collect())
    cur = con.execute(sql)
    names, expected = rows([d[0] for d in cur.description], cur.fetchall())
    if own_names != names:
        return f"columns {own_names} and {names}"
    if own != expected:
        a, b = [r for r in own if r not in set(expected)][:3], [r for r in expected if r not in set(own)][:3]
        return f"{len(own)} and {len(expected)} rows; only here {a}; only there {b}"
    return ""
