"""Chronological splits, recency weights and time-series folds."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.config import SplitConfig
from duelframe.operators.ordering import global_index

HALF_LIFE_DAYS = 730


def split_label(config: SplitConfig, date: str | None = None) -> Column:
    """First split whose last day is not passed; null without a date."""
    day = F.col(date or config.date)
    label = F.when(day.isNotNull(), config.rest)
    for name, last in reversed(config.bounds):
        label = F.when(day <= F.lit(last).cast("date"), name).otherwise(label)
    return label


def with_split(df: DataFrame, config: SplitConfig, check: bool = False) -> DataFrame:
    """One table with a split column; ``check`` raises when a split is empty."""
    ends = [last for _, last in config.bounds]
    if any(a >= b for a, b in zip(ends, ends[1:])):
        raise ValueError("each split must end before the next one")
    out = df.withColumn("split", split_label(config))
    if check:
        present = {r.split for r in out.select("split").distinct().collect()}
        empty = set(config.names) - present
        if empty:
            raise ValueError(f"empty split: {sorted(empty)}")
    return out


def newest(df: DataFrame, date: str):
    return df.agg(F.max(date)).first()[0]


def calibration_split(train: DataFrame, date: str = "tourney_date", days: int = 90) -> DataFrame:
    """Mark the last ``days`` of the training rows as calibration rows."""
    last = newest(train, date)
    if last is None:
        raise ValueError("no dated training rows")
    return train.withColumn("part", F.when(F.col(date) > F.lit(last - timedelta(days=days)), "calibration").otherwise("train"))


def split_summary(df: DataFrame, label: str, groups: tuple[str, ...] = ("split",), date: str = "tourney_date") -> DataFrame:
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(label).cast("long").alias("positive_labels"),
        F.sum(1 - F.col(label)).cast("long").alias("negative_labels"),
        F.avg(label).alias("positive_rate"),
        F.min(date).alias("date_min"), F.max(date).alias("date_max"),
    )


def recency_weight(date: str, anchor, half_life_days: int = HALF_LIFE_DAYS) -> Column:
    """Half the weight for every ``half_life_days`` before the anchor day."""
    if half_life_days <= 0:
        raise ValueError("half life must be positive")
    return F.pow(F.lit(0.5), F.datediff(F.lit(anchor), F.col(date)) / F.lit(float(half_life_days)))


def with_recency_weight(df: DataFrame, date: str = "tourney_date", half_life_days: int = HALF_LIFE_DAYS) -> DataFrame:
    return df.withColumn("sample_weight", recency_weight(date, newest(df, date), half_life_days))


def weight_summary(weighted: DataFrame) -> DataFrame:
    """Spread of the weights. There is one weight per day, so the median's state is bounded by the calendar."""
    return weighted.agg(
        F.min("sample_weight").alias("min"), F.max("sample_weight").alias("max"),
        F.avg("sample_weight").alias("mean"), F.median("sample_weight").alias("median"),
    )


def time_series_folds(
    df: DataFrame, order: tuple[str, ...] = ("tourney_date", "match_id"), n_splits: int = 5,
    validation_fraction: float = 0.10, gap: int = 0,
) -> DataFrame:
    """Add the row's position and the fold that validates on it (null for rows that only train).

    Fold f validates on a fixed-size block and trains on every row before it,
    less ``gap`` rows: see :func:`fold_rows`.
    """
    if n_splits < 2 or not 0 < validation_fraction < 1:
        raise ValueError("need at least two splits and a fraction between 0 and 1")
    placed = global_index(df, order, "position")
    n = placed.count()
    size = max(1, int(validation_fraction * n))
    if n_splits * size + gap + 1 > n:
        raise ValueError("not enough rows for the requested folds")
    first = n - n_splits * size
    fold = F.floor((F.col("position") - first) / size).cast("int")
    return placed.withColumn("fold", F.when(F.col("position") >= first, fold)).withColumn("fold_size", F.lit(size)).withColumn(
        "first_validated", F.lit(first)
    )


def fold_rows(folds: DataFrame, fold: int, gap: int = 0) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of one fold."""
    start = F.col("first_validated") + fold * F.col("fold_size")
    return folds.filter(F.col("position") < start - gap), folds.filter(F.col("fold") == fold)
