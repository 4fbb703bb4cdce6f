"""Compare a query with its oracle the way the driver does: names, rows, values."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.10g}"
    return str(v)


def _rows(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(_cell(r[i]) for i in at) for r in rows)


def difference(df, con, oracle: str) -> str | None:
    """None when equal, else a short description."""
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(oracle)
    want_cols, want = [d[0] for d in cur.description], cur.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(set(got_cols) ^ set(want_cols))}"
    a, b = _rows(got_cols, got), _rows(want_cols, want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        names = sorted(got_cols)
        cells = [(n, p, q) for n, p, q in zip(names, x, y) if p != q]
        return f"{len(bad)} of {len(a)} rows differ, e.g. {cells[:6]}"
    kinds = dict(df.dtypes)
    groups = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean"}
    odd = [
        (d[0], str(d[1]), kinds[d[0]]) for d in cur.description if groups.get(str(d[1]), str(d[1])) != kinds[d[0]]
    ]
    return f"types {odd}" if odd else None
