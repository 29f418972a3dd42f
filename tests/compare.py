"""Comparing a registered query with its SQL twin."""

from __future__ import annotations

import datetime as dt

import duckdb

from registry.inputs import TABLES

_KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _text(value) -> str:
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    return repr(value)


def differences(df, con, sql: str) -> list[str]:
    """Reasons why the results differ; empty when they are equal."""
    ours = {f.name: _KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    result = con.execute(sql)
    theirs = {d[0]: str(d[1]) for d in result.description}
    if set(ours) != set(theirs):
        return [f"columns differ: only here {set(ours) - set(theirs)}, only there {set(theirs) - set(ours)}"]
    found = [f"{c}: {ours[c]} against {theirs[c]}" for c in sorted(ours) if ours[c] != theirs[c]]
    names = sorted(ours)
    order = [list(theirs).index(c) for c in names]
    left = sorted(tuple(_text(r[c]) for c in names) for r in df.collect())
    right = sorted(tuple(_text(r[i]) for i in order) for r in result.fetchall())
    if len(left) != len(right):
        found.append(f"rows: {len(left)} against {len(right)}")
    if left != right:
        only = sorted(set(left) - set(right))[:3]
        other = sorted(set(right) - set(left))[:3]
        found.append(f"values differ, e.g. {only} against {other}")
    if not left:
        found.append("no rows on either side")
    return found
