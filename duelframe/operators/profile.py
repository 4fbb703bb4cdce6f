"""Data profiling and validation, each in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def summary(df: DataFrame, date: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, columns, dated rows, and the first and last date, in all or per file, tour, ..."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"), F.count(date).alias("dated"),
        F.min(date).alias("first_date"), F.max(date).alias("last_date"),
    )


def first_rows(df: DataFrame, order: Sequence[str], rows: int = 5) -> DataFrame:
    """The first rows in a stated order, missing values last."""
    return df.orderBy(*[F.asc_nulls_last(c) for c in order]).limit(rows)


def value_counts(df: DataFrame, fields: Sequence[str], top: int = 10) -> DataFrame:
    """Most frequent values per field, nulls included, ties by value."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    counts = (
        df.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("rows"))
    )
    place = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("rows"), F.asc_nulls_last("value")))
    return counts.withColumn("place", place).filter(F.col("place") <= top)


def missing_share(df: DataFrame, top: int = 15) -> DataFrame:
    """Share of nulls per column, largest first."""
    shares = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("missing")) for c in df.columns])
    return (
        shares.select(F.explode(pairs).alias("p")).select("p.*")
        .orderBy(F.desc("missing"), "column_name").limit(top)
    )


def text_share(df: DataFrame, column: str, tokens: dict[str, str]) -> DataFrame:
    """Share of rows whose text holds each token, whatever the case; null does not."""
    text = F.upper(F.coalesce(F.col(column), F.lit("")))
    return df.agg(*[F.avg(text.contains(t.upper()).cast("double")).alias(n) for n, t in tokens.items()])


def schema_dump(df: DataFrame) -> DataFrame:
    """Name and type of each column, with the row count."""
    columns = F.array(
        *[F.struct(F.lit(n).alias("column_name"), F.lit(t).alias("data_type")) for n, t in df.dtypes]
    )
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.explode(columns).alias("c"), "rows").select("c.*", "rows")


def validation_counts(df: DataFrame, checks: dict) -> DataFrame:
    """Rows in all and rows failing each check, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(bad).alias(n) for n, bad in checks.items()])


def demand_valid(df: DataFrame, checks: dict) -> DataFrame:
    """Raise when any check fails; otherwise hand the table on."""
    bad = validation_counts(df, checks).first().asDict()
    failed = {n: c for n, c in bad.items() if n != "rows" and c}
    if failed:
        raise ValueError(f"invalid rows: {failed}")
    return df


def unpaired_contests(sides: DataFrame, key: str = "match_id") -> DataFrame:
    """Contests, by tour and key, whose number of side rows is not two."""
    return sides.groupBy("tour", key).agg(F.count(F.lit(1)).alias("rows")).filter("rows <> 2")
