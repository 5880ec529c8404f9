"""Compares a Spark result with the result of its SQL in DuckDB: columns, types, and rows regardless of order."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb

KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def differences(df, con, sql: str) -> list[str]:
    """Empty if both agree."""
    relation = con.sql(sql)
    ours = dict(df.dtypes)
    theirs = {name: str(kind) for name, kind in zip(relation.columns, relation.types)}
    found = []
    if sorted(ours) != sorted(theirs):
        return [f"columns {sorted(ours)} against {sorted(theirs)}"]
    for name, kind in ours.items():
        if KINDS.get(kind) != theirs[name]:
            found.append(f"type of {name}: {kind} against {theirs[name]}")
    names = sorted(ours)
    left = Counter(tuple(row[n] for n in names) for row in df.collect())
    order = [relation.columns.index(n) for n in names]
    right = Counter(tuple(row[i] for i in order) for row in relation.fetchall())
    if left != right:
        only_left, only_right = left - right, right - left
        found.append(f"{sum(left.values())} against {sum(right.values())} rows, e.g. {list(only_left)[:2]} against {list(only_right)[:2]}")
    return found
