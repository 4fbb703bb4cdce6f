"""Global positions and running totals over any order, without a single-task window.

Rows are range-partitioned by the whole order, so one heavy key is spread over
many blocks. Each block is numbered on its own, and the small per-block totals
give every block its starting offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.session import spool

BLOCK = "_order_block"
POS = "_order_at"


def nulls_last(order: Sequence[str]) -> list[Column]:
    """Ascending order in which missing values come last."""
    return [F.asc_nulls_last(c) for c in order]


def ordered_blocks(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Range-partitioned, sorted and written copy with a block and a position.

    The position grows along ``order`` over the whole table, nulls last. The copy is written
    because range bounds are sampled and may differ on recomputation.
    """
    placed = (
        df.repartitionByRange(*nulls_last(order))
        .sortWithinPartitions(*nulls_last(order))
        .withColumn(BLOCK, F.spark_partition_id())
        .withColumn(POS, F.monotonically_increasing_id())
    )
    return spool(placed, "blocks")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with null equal to null; the keys of the right side are dropped."""
    renamed = right.toDF(*[f"_r_{c}" if c in keys else c for c in right.columns])
    same = None
    for k in keys:
        match = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        same = match if same is None else same & match
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def _offsets(blocks: DataFrame, group: Sequence[str], totals: list) -> DataFrame:
    """Totals of all earlier blocks of the same group (one row per group and block)."""
    per_block = blocks.groupBy(*group, BLOCK).agg(F.min(POS).alias("_order_first"), *totals)
    earlier = Window.partitionBy(*group).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    names = [c for c in per_block.columns if c not in (*group, BLOCK, "_order_first")]
    return per_block.select(
        *group,
        BLOCK,
        "_order_first",
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in names],
    )


def global_index(
    df: DataFrame, order: Sequence[str], name: str, group: Sequence[str] = ()
) -> DataFrame:
    """Add the 0-based position of each row along ``order`` within its group.

    ``order`` must identify rows; ties are placed arbitrarily but once only.
    """
    blocks = ordered_blocks(df, [*group, *order])
    offsets = _offsets(blocks, group, [F.count(F.lit(1)).alias("_order_before")])
    if not group:  # one row per block, so bounded by the number of partitions
        offsets = F.broadcast(offsets)
    return (
        join_null_safe(blocks, offsets, [*group, BLOCK])
        .withColumn(name, F.col("_order_before") + F.col(POS) - F.col("_order_first"))
        .drop(BLOCK, POS, "_order_first", "_order_before")
    )


def running_total(
    df: DataFrame, order: Sequence[str], values: dict[str, str], group: Sequence[str] = ()
) -> DataFrame:
    """Add, per ``{new: source}``, the sum of ``source`` over all earlier rows of the group."""
    blocks = ordered_blocks(df, [*group, *order])
    totals = [F.sum(F.coalesce(src, F.lit(0))).alias(f"_off_{new}") for new, src in values.items()]
    offsets = _offsets(blocks, group, totals)
    if not group:
        offsets = F.broadcast(offsets)
    inside = (
        Window.partitionBy(*group, BLOCK).orderBy(POS).rowsBetween(Window.unboundedPreceding, -1)
    )
    inner = [F.coalesce(F.sum(src).over(inside), F.lit(0)).alias(f"_in_{new}") for new, src in values.items()]
    out = join_null_safe(blocks.select("*", *inner), offsets, [*group, BLOCK])
    for new in values:
        out = out.withColumn(new, F.col(f"_off_{new}") + F.col(f"_in_{new}"))
    return out.select(*df.columns, *values)
