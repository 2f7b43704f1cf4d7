"""Compare a Spark result with its SQL twin on DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb

TYPES = {
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "double": {"DOUBLE"},
    "float": {"FLOAT"},
    "string": {"VARCHAR"},
    "boolean": {"BOOLEAN"},
    "timestamp_ntz": {"TIMESTAMP"},
    "timestamp": {"TIMESTAMP", "TIMESTAMP WITH TIME ZONE"},
    "date": {"DATE"},
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return f"decimal {v}"
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return repr(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql) -> list[str]:
    """Differences as text; empty when both sides agree exactly."""
    problems = []
    names = df.columns
    kinds = dict(df.dtypes)
    got = _rows(names, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    other = [c[0] for c in cur.description]
    kinds2 = {c[0]: str(c[1]) for c in cur.description}
    want = _rows(other, cur.fetchall())
    if sorted(names) != sorted(other):
        return [f"columns {sorted(names)} != {sorted(other)}"]
    for n in names:
        if kinds2[n] not in TYPES.get(kinds[n], {kinds2[n]}):
            problems.append(f"type of {n}: {kinds[n]} != {kinds2[n]}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        only_got, only_want = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
        problems.append(f"values: columns {sorted(names)}\n  spark  {only_got}\n  duckdb {only_want}")
    return problems
