"""Compares a query's rows with those of its SQL in DuckDB: names, kinds and values, in any order."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v) if v != v.to_integral_value() else int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def differences(spark_df, con, sql: str) -> list[str]:
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    kinds = {d[0]: str(d[1]).upper() for d in got.description}
    theirs = rows(names, got.fetchall())
    mine = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    out = []
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} and {sorted(names)}"]
    for c, k in spark_df.dtypes:
        kind = kinds[c]
        fits = {"bigint": ("BIGINT", "HUGEINT", "UBIGINT"), "int": ("INTEGER", "BIGINT", "NUMBER"), "double": ("DOUBLE",), "string": ("VARCHAR", "STRING"), "boolean": ("BOOLEAN", "BOOL")}.get(k)
        if fits and not any(f in kind for f in fits):
            out.append(f"{c}: {k} and {kind}")
    if len(mine) != len(theirs):
        out.append(f"{len(mine)} rows and {len(theirs)}")
    bad = [(a, b) for a, b in zip(mine, theirs, strict=False) if a != b]
    if bad:
        out.append(f"{len(bad)} rows differ: {bad[:2]}")
    return out
