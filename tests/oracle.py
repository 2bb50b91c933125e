"""Holds a query's rows against DuckDB's for the SQL that says the same."""

import math
from pathlib import Path

import duckdb

#: DuckDB's names of Spark's types.
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "tinyint": "TINYINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


def connect(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return bytes(x).hex() if isinstance(x, bytes | bytearray) else str(x)


def differences(con, df, sql):
    """What differs, in words; empty if nothing does."""
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return f"columns {names} and {sorted(rel.columns)}"
    kinds = {n: TYPES.get(t, t) for n, t in df.dtypes}
    theirs = {n: str(t) for n, t in zip(rel.columns, rel.types, strict=True)}
    loose = {n for n in names if kinds[n] != theirs[n] and not (kinds[n].startswith("decimal") and theirs[n].startswith("DECIMAL"))}
    if loose:
        return "types " + ", ".join(f"{n}: {kinds[n]} and {theirs[n]}" for n in sorted(loose))
    a = sorted(tuple(value(r[n]) for n in names) for r in df.collect())
    at = [rel.columns.index(n) for n in names]
    b = sorted(tuple(value(r[i]) for i in at) for r in rel.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    return next((f"{x} and {y}" for x, y in zip(a, b, strict=True) if x != y), "")
