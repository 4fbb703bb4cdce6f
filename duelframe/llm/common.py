"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Hashable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.session import ship, spool

ship(__name__)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its DuckDB counterpart if there is one."""

    def register(build: Query) -> Query:
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = oracle
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(text, ASCII_UPPER, ASCII_UPPER.lower())


def fold_of(id_column: str, folds: int) -> Column:
    """crc32 of an id's decimal text modulo ``folds`` (null ids: null)."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds


def fresh_name(columns: Iterable[str], stem: str) -> str:
    """A column name that clashes with none of ``columns`` (names are compared without case)."""
    taken = {c.lower() for c in columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Rows up to which a written table of a few numbers per row is broadcast (at most some 30 MB).
BROADCAST_ROWS = 400_000


def join_sized(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join with a right side of short rows, broadcast if its counted rows are few, shuffled if not."""
    few = right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return left.join(F.broadcast(right) if few else right, keys, how)


def once_per_worker(slot: str, key: Hashable, build: Callable[[], object]) -> object:
    """A value that a Python worker builds once and keeps for its later tasks.

    A worker keeps one such value: another one takes its place, so that the
    stages of a long job do not add up in memory.
    """
    kept = _kept_by_worker()
    if (slot, key) not in kept:
        forget_kept()
        kept[slot, key] = build()
    return kept[slot, key]


def forget_kept() -> None:
    """Let go of what earlier tasks of this Python worker have kept."""
    _kept_by_worker().clear()
    give_back()


def give_back() -> None:
    """Return the free memory of this Python worker to the system.

    A worker lives through all stages of a job: without this, what each needed at
    its peak stays with the worker while the JVM and later stages grow.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _kept_by_worker() -> dict:
    return sys.modules["__main__"].__dict__.setdefault("_kept_by_worker", {})


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Components of an undirected graph given as (a, b) rows of long ids.

    Returns (node, component) for every node with an edge to another one; the
    component is the smallest id in it. Each round lets a node hook onto the
    smallest hash in its neighbourhood and contracts the graph, so the nodes
    left shrink geometrically, hubs cost rows in proportion to their links and
    no group is gathered. Every round is written to the shared folder; the
    driver only learns whether links are left.
    """

    def rank(c: str) -> Column:
        return F.struct(F.xxhash64(F.col(c)).alias("h"), F.col(c).alias("id"))

    current = spool(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), label
    )
    levels: list[DataFrame] = []
    while not current.isEmpty():
        both = current.select("a", "b").union(current.select(F.col("b"), F.col("a")))
        hooks = spool(
            both.groupBy(F.col("a").alias("node"))
            .agg(F.min(rank("b")).alias("best"))
            .select("node", F.least(rank("node"), F.col("best"))["id"].alias("up")),
            label,
        )
        levels.append(hooks)
        left = hooks.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        right = hooks.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        current = spool(
            current.join(left, "a").join(right, "b")
            .select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
            .where("a < b").distinct(),
            label,
        )
    if not levels:
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = levels[0]
    for level in levels[1:]:
        step = level.select(F.col("node").alias("up"), F.col("up").alias("next"))
        roots = roots.join(step, "up", "left").select("node", F.coalesce("next", "up").alias("up"))
    roots = spool(roots, label)
    smallest = roots.groupBy("up").agg(F.min("node").alias("component"))
    return roots.join(smallest, "up").select("node", "component")
