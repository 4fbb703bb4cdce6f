"""Coercion, category clean-up and small text rules as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values
ROUND_ORDINALS = {"RR": 0, "R128": 1, "R64": 2, "R32": 3, "R16": 4, "QF": 5, "SF": 6, "F": 7}
DROPPED_ROUNDS = ("BR", "3RD/4TH")
MODEL_SURFACES = ("HARD", "CLAY", "GRASS")
TRUTHY = ("1", "TRUE", "T", "YES", "Y")


def to_double(column: str | Column) -> Column:
    """Number or null: unreadable text, NaN and infinities become null."""
    value = F.col(column) if isinstance(column, str) else column
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def to_long(column: str | Column) -> Column:
    return to_double(column).try_cast("long")


def coerce_numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    wanted = {c for c in columns if c in df.columns}
    return df.select(*[to_double(c).alias(c) if c in wanted else F.col(c) for c in df.columns])


def parse_yyyymmdd(column: str | Column) -> Column:
    """Date from YYYYMMDD text or number, tolerating a trailing ``.0``; bad text is null."""
    value = F.col(column) if isinstance(column, str) else column
    text = F.trim(F.regexp_replace(value.cast("string"), r"\.0$", ""))
    # the parser alone would accept shorter digit runs
    return F.when(text.rlike("^[0-9]{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))


def category_upper(column: str | Column) -> Column:
    """Ingest form of a category: trimmed upper case, null kept."""
    value = F.col(column) if isinstance(column, str) else column
    return F.upper(F.trim(value))


def category_or(column: str | Column, allowed: Iterable[str], otherwise: str) -> Column:
    """Title-case category, with one fallback for anything not allowed, null included."""
    value = F.col(column) if isinstance(column, str) else column
    title = F.initcap(F.trim(value))
    return F.when(title.isin(list(allowed)), title).otherwise(F.lit(otherwise))


def text_or(column: str | Column, otherwise: str) -> Column:
    """Trimmed upper-case text, with a default for null and blank."""
    value = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.nullif(F.upper(F.trim(value)), F.lit("")), F.lit(otherwise))


def truthy(column: str | Column) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.upper(F.trim(value.cast("string"))).isin(list(TRUTHY)), F.lit(False))


def round_ordinal(column: str | Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ROUND_ORDINALS.items() for x in pair])
    return F.try_element_at(table, text_or(column, ""))


def optional(df: DataFrame, name: str, default=None, kind: str | None = None) -> Column:
    """The column when it exists, else a default: schema differences are settled at plan time."""
    if name in df.columns:
        return F.col(name)
    value = F.lit(default)
    return value.cast(kind) if kind else value


def require(df: DataFrame, columns: Iterable[str], what: str) -> None:
    """Raise before any job runs when columns are missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks required columns: {', '.join(missing)}")


def places(name: str) -> int:
    """Decimals kept in a compared result: ratings accumulate rounding noise over long chains."""
    if "elo" in name or "surface_advantage" in name:
        return 6
    return 11 if name in ("min", "max", "mean") else 9


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column; adding zero turns -0.0 into 0.0."""
    return df.select(
        *[
            (F.round(F.col(f"`{n}`"), places(n)) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )
