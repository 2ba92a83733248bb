"""Run registered queries next to their SQL and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "float": "FLOAT", "boolean": "BOOLEAN"}


def sql_rows(con: duckdb.DuckDBPyConnection, sql: str):
    cursor = con.execute(sql)
    names = [(d[0], str(d[1])) for d in cursor.description]
    return names, cursor.fetchall()


def key(row):
    return tuple((v is None, str(type(v)), v if v is not None and not (isinstance(v, float) and math.isnan(v)) else str(v)) for v in row)


def differences(df, con, sql: str) -> list[str]:
    """Empty when names, types and all rows agree."""
    names, expected = sql_rows(con, sql)
    order = sorted(df.columns)
    found_types = {f.name: SPARK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    expected_types = dict(names)
    if found_types != expected_types:
        return [f"types: spark {found_types}, sql {expected_types}"]
    at = [[n for n, _ in names].index(c) for c in order]
    want = sorted((tuple(r[i] for i in at) for r in expected), key=key)
    got = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in order]).collect()), key=key)
    if len(want) != len(got):
        return [f"rows: spark {len(got)}, sql {len(want)}"]
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return [f"{order}: spark {g}, sql {w}" for g, w in bad[:3]] + ([f"{len(bad)} rows differ"] if bad else [])
