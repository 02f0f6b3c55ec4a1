"""Runs the registered queries in Spark and their SQL in the check engine and compares.

    python -m checks.compare [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks.oracle import oracle_sql
from checks.queries import queries
from snaplytics.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
# DuckDB type -> Spark type, for the types that occur.
TYPES = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def _sortable(row) -> tuple:
    return tuple((v is None, type(v).__name__, 0.0 if v is None else (-0.0 + 0.0 if v == 0 else v)) for v in row)


def difference(df, con, sql: str) -> str | None:
    """None when both give the same columns, types and rows in any order."""
    relation = con.sql(sql)
    ours = dict(df.dtypes)
    theirs = {c: TYPES.get(str(t), str(t)) for c, t in zip(relation.columns, relation.types)}
    if ours != theirs:
        names = sorted(c for c in {*ours, *theirs} if ours.get(c) != theirs.get(c))
        return "columns: " + ", ".join(f"{c} {ours.get(c)}/{theirs.get(c)}" for c in names)
    columns = sorted(ours)
    left = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=_sortable)
    quoted = ", ".join(f'"{c}"' for c in columns)
    right = sorted(con.sql(f"select {quoted} from ({sql})").fetchall(), key=_sortable)
    if len(left) != len(right):
        return f"rows: {len(left)}/{len(right)}"
    for a, b in zip(left, right):
        if any(isinstance(v, float) and math.isnan(v) for v in (*a, *b)):
            return f"NaN in {a} / {b}"
        if a != b:
            return "first difference: " + ", ".join(f"{c} {x!r}/{y!r}" for c, x, y in zip(columns, a, b) if x != y)
    return None


def main(folder: str = "/root/testdata/sf0.01", *names: str) -> int:
    spark, con = local_session("compare"), connect(folder)
    texts, bad = oracle_sql(), 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            found = difference(df, con, texts[name]) if name in texts else f"no SQL; {df.count()} rows"
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += found is not None and not found.startswith("no SQL")
        print(f"{name:28s} {time.time() - start:6.2f}s  {found or 'equal'}", flush=True)
    print(f"{bad} different")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
