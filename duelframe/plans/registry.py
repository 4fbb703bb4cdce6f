"""Named queries with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from duelframe.functions.coerce import places, rounded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def sql(ctes: Sequence[str], body: str, doubles: Sequence[str] = ()) -> str:
    """One statement: the CTEs, then ``body`` with its double columns rounded."""
    if doubles:
        fixed = ", ".join(f"round({d}, {places(d)}) + 0.0 AS {d}" for d in doubles)
        body = f"SELECT * REPLACE ({fixed}) FROM ({body})"
    head = "WITH RECURSIVE " + ", ".join(c.strip().rstrip(",") for c in ctes) if ctes else ""
    return f"{head} {body}"


def query(name: str, oracle: str | None = None):
    """Register a query; its double columns are rounded as in the oracle."""

    def register(build: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(build(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return build

    return register
