"""Compare a Spark result with its oracle SQL: columns, types, rows, values."""

from __future__ import annotations

import math
from collections import Counter
from datetime import datetime
from pathlib import Path

import duckdb

KINDS = {
    "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT",
    "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0  # -0.0 as 0.0
    if isinstance(v, datetime):
        return v.replace(tzinfo=None)
    return v


def _bag(rows, order):
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> list[str]:
    """What differs, empty if nothing does."""
    rel = con.sql(sql)
    problems = []
    left = {c: t for c, t in df.dtypes}
    right = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    if sorted(left) != sorted(right):
        return [f"columns {sorted(left)} != {sorted(right)}"]
    for c in left:
        want = KINDS.get(left[c], left[c])
        if want != right[c]:
            problems.append(f"type of {c}: {left[c]} != {right[c]}")
    names = sorted(left)
    spark_rows = [tuple(r) for r in df.collect()]
    a = _bag(spark_rows, [df.columns.index(c) for c in names])
    b = _bag(rel.fetchall(), [rel.columns.index(c) for c in names])
    if a != b:
        problems.append(
            f"rows {sum(a.values())} vs {sum(b.values())}; only spark {list((a - b).items())[:3]}; "
            f"only oracle {list((b - a).items())[:3]}"
        )
    return problems
