"""Run a query in both engines and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([_plain(r[i]) for i in order] for r in rows), key=repr)


# Joins that pair every row with every row, and Python inside the plan.
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas")

KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
         "TIMESTAMP": "timestamp_ntz"}


def compare(spark, con, sf_dir, query, sql) -> str | None:
    """None if both agree, else what differs."""
    df = query(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if found := [w for w in UNWANTED if w in plan]:
        return f"plan has {found}"
    result = con.execute(sql)
    described = [(d[0], str(d[1])) for d in result.description]
    expected = result.fetchall()
    ours = {f.name: f.dataType.simpleString() for f in df.schema}
    theirs = {n: KINDS.get(t, t) for n, t in described}
    if ours != theirs:
        return f"schema: {sorted(ours.items())} != {sorted(theirs.items())}"
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    want = _rows([n for n, _ in described], expected)
    if len(got) != len(want):
        return f"rows: {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else None
