"""Compare a registered query with its DuckDB oracle, value by value."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import re

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return "NaN"
        return repr(f + 0.0 if f != 0 else 0.0)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return str(v)


def kind(v):
    if v is None:
        return None
    return type(v).__name__


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = sorted(tuple(cell(r[i]) for i in order) for r in rows)
    kinds = [next((kind(r[i]) for r in rows if r[i] is not None), None) for i in order]
    return [columns[i] for i in order], out, kinds


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return rows_of(columns, cur.fetchall())


def difference(df, con, sql) -> str | None:
    """None when equal, else what differs."""
    sc, sr, sk = spark_rows(df)
    dc, dr, dk = duck_rows(con, sql)
    if sc != dc:
        return f"columns {sc} != {dc}"
    if len(sr) != len(dr):
        return f"row count {len(sr)} != {len(dr)}; first {sr[:2]} / {dr[:2]}"
    if sk != dk:
        return f"types {list(zip(sc, sk, dk))}"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        return f"{len(bad)} of {len(sr)} rows differ, e.g. spark {bad[0][0]} duckdb {bad[0][1]} (columns {sc})"
    return None


# These run jobs while being built (streams, learned models, written files); the plan left at the end is a file scan.
EAGER = re.compile(r"^(T[24567]_|E1[345]_|E16_.*_ml|A(2|3|4|12|14|15|16|17)_|A(8|9|11)_.*_stored)")


def assert_scalable(df) -> None:
    """No product or nested-loop join, no row-at-a-time Python, no window without a partition key."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastHashJoin", "BatchEvalPython"):
        assert node not in plan, node
    for line in plan.splitlines():
        if re.search(r"\bWindow \[", line):
            assert re.search(r"\], \[[a-z_]", line), line
