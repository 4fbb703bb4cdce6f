"""Prior-only window features with a plan for heavy groups.

Every measure looks at earlier rows of the same group; the current row never
counts. Ordinary groups use native windows, so several groupings that share a
leading key need one shuffle. Groups above ``heavy_rows`` are cut into chunks
of consecutive rows: row frames get the last rows of the chunk before,
unbounded frames get a carry from earlier chunks, and day frames run over one
row per day. Both plans give the same values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from duelframe.operators.ordering import global_index, join_null_safe, nulls_last
from duelframe.session import spool

HEAVY_ROWS = 2_000_000
CHUNK_ROWS = 262_144
AGGREGATES = ("mean", "sum", "count", "max", "last")
FRAMES = ("rows", "days", "all")


@dataclass(frozen=True)
class Prior:
    """One output column computed from earlier rows.

    agg     mean, sum, count, max or last (last value in order that is not null)
    frame   rows (the ``size`` rows before), days (``size`` days before the
            row's day, the day itself excluded) or all (every earlier row)
    own     the row itself counts too, as its last row (rows and all frames)
    """

    out: str
    agg: str
    source: str | None = None
    frame: str = "rows"
    size: int = 0
    at_least: int = 1
    own: bool = False

    def __post_init__(self) -> None:
        if self.agg not in AGGREGATES or self.frame not in FRAMES:
            raise ValueError(f"unknown aggregate {self.agg} or frame {self.frame}")
        if self.frame == "days" and self.own:
            raise ValueError("a day frame never holds the row's own day")

    @property
    def last_row(self) -> int:
        return 0 if self.own else -1

    @property
    def first_row(self) -> int:
        return 1 - self.size if self.own else -self.size


def _aggregate(m: Prior, source: Column | None, window) -> Column:
    if m.agg == "count":
        return F.count(F.lit(1) if source is None else source).over(window)
    if m.agg == "mean":
        value = F.avg(source).over(window)
        if m.at_least > 1:
            value = F.when(F.count(source).over(window) >= m.at_least, value)
        return value
    if m.agg == "sum":
        return F.sum(source).over(window)
    if m.agg == "max":
        return F.max(source).over(window)
    return F.last(source, ignorenulls=True).over(window)


def _newest(source: Column, order: Sequence[str]) -> Column:
    """Value of the last row in ``order`` (nulls last) whose value is not null."""
    place = F.struct(*[x for i, c in enumerate(order) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}"))])
    return F.max_by(source, F.when(source.isNotNull(), place))


def _day_number(df: DataFrame, day: str) -> Column:
    """Days are dates, or numbers of days already."""
    return F.unix_date(day) if isinstance(df.schema[day].dataType, DateType) else F.col(day)


def _native(df: DataFrame, keys: Sequence[str], order: Sequence[str], day: str | None,
            measures: Sequence[Prior]) -> DataFrame:
    by_row = Window.partitionBy(*keys).orderBy(*nulls_last(order))
    framed, daily = [], []
    for m in measures:
        source = F.col(m.source) if m.source else None
        if m.frame == "days":
            w = Window.partitionBy(*keys).orderBy(_day_number(df, day).asc_nulls_last()).rangeBetween(-m.size, -1)
            # rows of a day are peers in such a frame, so the last one is found by the order itself
            value = _newest(source, order).over(w) if m.agg == "last" else _aggregate(m, source, w)
            daily.append(F.when(F.col(day).isNotNull(), value).alias(m.out))
        elif m.frame == "rows":
            framed.append(_aggregate(m, source, by_row.rowsBetween(m.first_row, m.last_row)).alias(m.out))
        else:
            framed.append(_aggregate(m, source, by_row.rowsBetween(Window.unboundedPreceding, m.last_row)).alias(m.out))
    # an order that begins with the number of the day sorts for the day frames too, so they come second
    for columns in (framed, daily):
        df = df.select("*", *columns) if columns else df
    return df.select(*[c for c in df.columns if c not in {m.out for m in measures}], *[m.out for m in measures])


#: What a day must hold for an aggregate: count, sum, largest and last value.
_DAILY = {"count": "n", "mean": "ns", "sum": "s", "max": "x", "last": "l"}


def _chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str], day: str | None,
             measures: Sequence[Prior], chunk_rows: int) -> DataFrame:
    reach = max([m.size for m in measures if m.frame == "rows"], default=0)
    chunk_rows = max(chunk_rows, reach, 1)
    rows = global_index(df, [*keys, *order], "_at").withColumn(
        "_chunk", F.floor(F.col("_at") / chunk_rows).cast("long")
    )
    unbounded = [m for m in measures if m.frame == "all"]
    framed = [m for m in measures if m.frame == "rows"]
    daily = [m for m in measures if m.frame == "days"]

    out = rows
    if framed or unbounded:
        # the tail of a chunk is also handed to the next chunk, as context only
        tail = F.col("_at") % chunk_rows >= chunk_rows - reach
        seen = rows.withColumn(
            "_to", F.explode(F.when(tail, F.array("_chunk", F.col("_chunk") + 1)).otherwise(F.array("_chunk")))
        ).withColumn("_context", F.col("_to") != F.col("_chunk"))
        w = Window.partitionBy("_to", *keys).orderBy("_at")
        columns = []
        for m in framed:
            columns.append(
                _aggregate(m, F.col(m.source) if m.source else None, w.rowsBetween(m.first_row, m.last_row)).alias(m.out)
            )
        for m in unbounded:
            before = w.rowsBetween(Window.unboundedPreceding, m.last_row)
            own = F.when(~F.col("_context"), F.col(m.source) if m.source else F.lit(1))
            if m.agg in ("mean", "count"):
                columns.append(F.count(own).over(before).alias(f"_n_{m.out}"))
            if m.agg in ("mean", "sum"):
                columns.append(F.sum(own).over(before).alias(f"_s_{m.out}"))
            if m.agg == "max":
                columns.append(F.max(own).over(before).alias(f"_x_{m.out}"))
            if m.agg == "last":
                columns.append(F.last(own, ignorenulls=True).over(before).alias(f"_l_{m.out}"))
        out = seen.select("*", *columns).filter(~F.col("_context")).drop("_to", "_context")

    if unbounded:
        totals = []
        for m in unbounded:
            own = F.col(m.source) if m.source else F.lit(1)
            if m.agg in ("mean", "count"):
                totals.append(F.count(own).alias(f"_cn_{m.out}"))
            if m.agg in ("mean", "sum"):
                totals.append(F.sum(own).alias(f"_cs_{m.out}"))
            if m.agg == "max":
                totals.append(F.max(own).alias(f"_cx_{m.out}"))
            if m.agg == "last":
                totals.append(
                    F.max_by(own, F.when(own.isNotNull(), F.col("_at"))).alias(f"_cl_{m.out}")
                )
        per_chunk = rows.groupBy(*keys, "_chunk").agg(*totals)
        earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        carry_columns = []
        for name in per_chunk.columns:
            if name.startswith(("_cn_", "_cs_")):
                carry_columns.append(F.sum(name).over(earlier).alias(name))
            elif name.startswith("_cx_"):
                carry_columns.append(F.max(name).over(earlier).alias(name))
            elif name.startswith("_cl_"):
                carry_columns.append(F.last(name, ignorenulls=True).over(earlier).alias(name))
        carry = per_chunk.select(*keys, "_chunk", *carry_columns)
        out = join_null_safe(out, carry, [*keys, "_chunk"])
        zero = F.lit(0)
        for m in unbounded:
            count = F.coalesce(F.col(f"_cn_{m.out}"), zero) + F.coalesce(F.col(f"_n_{m.out}"), zero) \
                if m.agg in ("mean", "count") else None
            total = F.coalesce(F.col(f"_cs_{m.out}") + F.col(f"_s_{m.out}"), f"_cs_{m.out}", f"_s_{m.out}") \
                if m.agg in ("mean", "sum") else None
            if m.agg == "count":
                value = count
            elif m.agg == "sum":
                value = total
            elif m.agg == "mean":
                value = F.when(count >= m.at_least, F.try_divide(total, count))
            elif m.agg == "max":
                value = F.greatest(f"_cx_{m.out}", f"_x_{m.out}")
            else:
                value = F.coalesce(f"_l_{m.out}", f"_cl_{m.out}")
            out = out.withColumn(m.out, value)

    if daily:
        # a day is never split across frames, so one row per day is enough
        sources = sorted({m.source or "" for m in daily})
        name = {(kind, s): f"_d{kind}{i}" for i, s in enumerate(sources) for kind in "nsxl"}
        needed = {(kind, m.source or "") for m in daily for kind in _DAILY[m.agg]}
        per_day_values = []
        for s in sources:
            value = F.col(s) if s else F.lit(1)
            made = {"n": F.count(value), "s": F.sum(value), "x": F.max(value),
                    "l": F.max_by(value, F.when(value.isNotNull(), F.col("_at")))}
            per_day_values += [v.alias(name[kind, s]) for kind, v in made.items() if (kind, s) in needed]
        per_day = rows.filter(F.col(day).isNotNull()).groupBy(*keys, day).agg(*per_day_values)
        columns = []
        for m in daily:
            w = Window.partitionBy(*keys).orderBy(_day_number(df, day)).rangeBetween(-m.size, -1)
            n, s, x, last = (name[kind, m.source or ""] for kind in "nsxl")
            if m.agg == "count":
                value = F.coalesce(F.sum(n).over(w), F.lit(0))
            elif m.agg == "mean":
                value = F.when(F.coalesce(F.sum(n).over(w), F.lit(0)) >= m.at_least, F.try_divide(F.sum(s).over(w), F.sum(n).over(w)))
            elif m.agg == "sum":
                value = F.sum(s).over(w)
            elif m.agg == "max":
                value = F.max(x).over(w)
            else:
                value = F.last(last, ignorenulls=True).over(w)
            columns.append(value.alias(m.out))
        out = join_null_safe(out, per_day.select(*keys, day, *columns), [*keys, day], "left")
        # a missing day has no frame
        out = out.select(*[c for c in out.columns if c not in {m.out for m in daily}],
                         *[F.when(F.col(day).isNotNull(), F.coalesce(m.out, F.lit(0)) if m.agg == "count" else F.col(m.out)).alias(m.out) for m in daily])

    return out.select(*df.columns, *[m.out for m in measures])


def heavy_keys(df: DataFrame, keys: Sequence[str], heavy_rows: int = HEAVY_ROWS) -> DataFrame | None:
    """Keys with more than ``heavy_rows`` rows, or None; at most rows/heavy_rows of them."""
    big = df.groupBy(*keys).count().filter(F.col("count") > heavy_rows).select(*keys)
    written = spool(big, "heavy")
    return written if written.limit(1).count() else None


def prior_features(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    measures: Sequence[Prior],
    day: str | None = None,
    heavy: DataFrame | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``measures`` over earlier rows of each ``keys`` group.

    ``heavy`` lists the groups (by some leading subset of ``keys``, see
    :func:`heavy_keys`) that take the chunked plan; ``order`` must be total
    within a group.
    """
    if heavy is None:
        return _native(df, keys, order, day, measures)
    on = heavy.columns  # a missing key is a group like any other
    usual = join_null_safe(df, F.broadcast(heavy), on, "left_anti")
    large = join_null_safe(df, F.broadcast(heavy), on, "left_semi")
    return _native(usual, keys, order, day, measures).unionByName(
        _chunked(large, keys, order, day, measures, chunk_rows)
    )
