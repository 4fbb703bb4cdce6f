"""Model inputs: column lists, training rows, and preprocessing fitted on training rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelframe.functions.coerce import DROPPED_ROUNDS, MODEL_SURFACES, require, text_or, to_double
from duelframe.operators.pairing import CONTEST_FIELDS, PLAIN_DELTAS
from duelframe.session import ship

TARGET = "label_player_a_win"
NOT_INPUTS = {"delta_h2h_losses"}
SURFACE_FLAGS = ("is_clay", "is_grass")
CATEGORICAL = ("handedness_combo", "tourney_level")
METADATA = ("match_id", *CONTEST_FIELDS, *(f"player_{f}_{side}" for side in "ab" for f in ("id", "name")))
NUMERIC = tuple(
    [
        "delta_rank_adv", "delta_surface_advantage", "delta_age_30", "delta_age_int",
        *[c for c in PLAIN_DELTAS if c not in NOT_INPUTS],
        "h2h_matches_total", "first_meeting", "common_opp_count", "delta_common_opp_win_pct",
        "delta_common_opp_matches", "has_surface_history", *SURFACE_FLAGS, "same_hand", "round_rr",
        "round_ordinal", "best_of",
    ]
)


def numeric_features(surface_specific: bool = False) -> list[str]:
    """51 inputs, or 49 for a model of a single surface."""
    return [c for c in NUMERIC if not (surface_specific and c in SURFACE_FLAGS)]


def training_rows(wide: DataFrame, surface: str | None = None) -> DataFrame:
    """Typed rows for modelling: model surfaces only, third-place rounds dropped, one branch if asked."""
    require(wide, [*NUMERIC, *CATEGORICAL, TARGET, "tourney_date", "match_id"], "wide contests")
    name = F.upper(F.trim("surface"))
    rows = wide.filter(~text_or("round", "").isin(list(DROPPED_ROUNDS)) & name.isin(list(MODEL_SURFACES)))
    if surface is not None:
        wanted = surface.strip().upper()
        rows = rows.filter(name == ("HARD" if wanted == "CARPET" else wanted))
    best_of = to_double("best_of")
    return rows.select(
        *[c for c in METADATA if c in wide.columns and c not in ("tourney_level", "best_of")],
        *[(best_of if c == "best_of" else to_double(c)).alias(c) for c in NUMERIC],
        *[F.coalesce(F.col(c), F.lit("U")).alias(c) for c in CATEGORICAL],
        F.col(TARGET).cast("double").alias(TARGET),
    )


#: Bits that one scan settles; a scan counts so many values of them per column and open prefix.
DIGIT_BITS = 16


def _ordered_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles: NaN last, -0.0 as 0.0."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.uint64)
    top = np.uint64(1) << np.uint64(63)
    return np.where(bits & top, ~bits, bits | top)


def _double_of(bits: int) -> float:
    top = 1 << 63
    raw = bits ^ top if bits & top else bits ^ ((1 << 64) - 1)
    return float(np.array([raw], np.uint64).view(np.float64)[0])


def _digit_counts(columns: Sequence[str], prefixes: dict[str, set[int]], shift: int) -> Callable:
    """Counts of the digit at ``shift`` among the values of each column that begin with one of its prefixes."""
    width = np.uint64(DIGIT_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for at, name in enumerate(columns):
                bits = _ordered_bits(batch.column(at).drop_null().to_numpy(zero_copy_only=False).astype(np.float64))
                above = bits >> np.uint64(shift) >> width if shift + DIGIT_BITS < 64 else np.zeros_like(bits)
                digits = ((bits >> np.uint64(shift)) & np.uint64((1 << DIGIT_BITS) - 1)).astype(np.int64)
                for prefix in prefixes.get(name, ()):
                    found = np.bincount(digits[above == np.uint64(prefix)], minlength=1 << DIGIT_BITS)
                    held[name, prefix] = held[name, prefix] + found if (name, prefix) in held else found
        for (name, prefix), found in held.items():
            digits = np.flatnonzero(found)
            yield pa.RecordBatch.from_pydict({
                "feature": pa.array([name] * len(digits), pa.string()), "prefix": pa.array([prefix] * len(digits), pa.int64()),
                "digit": pa.array(digits, pa.int32()), "n": pa.array(found[digits], pa.int64()),
            })

    return count


def exact_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact median of every column, by four scans that settle 16 bits each of all of them at once.

    The scans read ``df`` itself, so it should be a written table or little more.
    A task keeps the counts of at most two open prefixes per column, and moves
    those above 0; the driver sees the one digit per column and middle that the
    counts lead to. Columns without values have no row.
    """
    ship(__name__)
    spark = df.sparkSession
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    names = list(columns)
    # of each column and middle: the bits known, and the place among the values that begin with them
    middles: dict[tuple[str, int], tuple[int, int | None]] = {(c, m): (0, None) for c in names for m in (0, 1)}
    digit_order = Window.partitionBy("feature", "prefix").orderBy("digit")
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        prefixes: dict[str, set[int]] = {}
        for (c, _), (prefix, _) in middles.items():
            prefixes.setdefault(c, set()).add(prefix)
        counts = values.mapInArrow(_digit_counts(names, prefixes, shift), "feature string, prefix long, digit int, n long")
        upto = F.sum("n").over(digit_order)
        ranked = counts.groupBy("feature", "prefix", "digit").agg(F.sum("n").alias("n")).select(
            "*", (upto - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("feature", "prefix")).alias("size")
        )
        asked = spark.createDataFrame(
            [(c, m, prefix, place) for (c, m), (prefix, place) in middles.items()], "feature string, middle int, prefix long, place long"
        )
        place = F.coalesce("place", F.floor((F.col("size") - 1 + F.col("middle")) / 2))
        # two rows per column are asked for, and two come back
        hits = ranked.join(F.broadcast(asked), ["feature", "prefix"]).withColumn("place", place).filter(
            (F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("n"))
        ).collect()
        middles = {(r.feature, r.middle): ((r.prefix << DIGIT_BITS) | r.digit, r.place - r.before) for r in hits}
    found = [(c, (_double_of(middles[c, 0][0]) + _double_of(middles[c, 1][0])) / 2.0) for c in names if (c, 0) in middles]
    return spark.createDataFrame(found, "feature string, median double")


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value per column, the smallest on ties."""
    counts = (
        df.select(*columns).unpivot([], list(columns), "feature", "value").filter("value is not null")
        .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.groupBy("feature").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))


def _moments(columns: Sequence[str]) -> Callable:
    """Per task and column: count, mean, sum of squared distances from it, least and largest value."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple] = {}
        for batch in batches:
            for at, name in enumerate(columns):
                values = batch.column(at).drop_null().to_numpy(zero_copy_only=False)
                if not len(values):
                    continue
                n, mean = len(values), float(values.mean())
                m2, low, high = float(np.square(values - mean).sum()), float(values.min()), float(values.max())
                if name in held:
                    n0, mean0, m20, low0, high0 = held[name]
                    apart, n = mean - mean0, n + n0
                    mean, m2 = mean0 + apart * (n - n0) / n, m2 + m20 + apart * apart * n0 * (n - n0) / n
                    low, high = float(np.minimum(low, low0)), float(np.maximum(high, high0))
                held[name] = n, mean, m2, low, high
        if held:
            kinds = (pa.int64(), *[pa.float64()] * 4)
            cells = {c: pa.array(v, t) for c, v, t in zip(("n", "mean", "m2", "low", "high"), zip(*held.values()), kinds)}
            yield pa.RecordBatch.from_pydict({"feature": pa.array(list(held), pa.string()), **cells})

    return measure


def scale_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation per column (the deviation of a constant counts as 1); null for a column without values.

    Tasks measure all columns at once, so no plan holds an aggregate per column.
    """
    ship(__name__)
    spark = df.sparkSession
    parts = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(
        _moments(list(columns)), "feature string, n long, mean double, m2 double, low double, high double"
    )
    of_all = Window.partitionBy("feature")
    apart = F.col("mean") - F.col("center")
    found = (
        parts.withColumn("center", F.sum(F.col("n") * F.col("mean")).over(of_all) / F.sum("n").over(of_all))
        .groupBy("feature").agg(
            F.first("center").alias("center"), F.min("low").alias("low"), F.max("high").alias("high"),
            F.sqrt(F.sum(F.col("m2") + F.col("n") * apart * apart) / F.sum("n")).alias("spread"),
        )
    )
    constant = (F.col("low") == F.col("high")) & ~F.isnan("low")
    named = spark.createDataFrame([(c,) for c in columns], "feature string")
    return named.join(found, "feature", "left").select(
        "feature", F.when(constant, F.col("low")).otherwise(F.col("center")).alias("mean"),
        F.when(constant | (F.col("spread") == 0), 1.0).otherwise(F.col("spread")).alias("std"),
    )


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.fillna({c: v for c, v in medians.items() if v is not None})


@dataclass(frozen=True)
class Preprocessor:
    """Fill and scale values learned from training rows; one value per column."""

    columns: tuple[str, ...]
    medians: dict[str, float]
    modes: dict[str, str]
    means: dict[str, float]
    deviations: dict[str, float]
    scaled: bool

    def stages(self) -> list:
        """Persistable pipeline stages ending in a ``features`` vector."""
        cells = []
        for c in self.columns:
            filled = f"coalesce({c}, {self.medians[c]!r}D)"
            if self.scaled:
                filled = f"({filled} - {self.means[c]!r}D) / {self.deviations[c]!r}D"
            cells.append(f"{filled} AS x_{c}")
        for c in CATEGORICAL:
            fill = self.modes[c].replace("'", "\\'")
            cells.append(f"coalesce({c}, '{fill}') AS x_{c}")
        return [
            SQLTransformer(statement=f"SELECT *, {', '.join(cells)} FROM __THIS__"),
            # an unseen category takes the extra index, which the encoder drops: all zeros
            StringIndexer(
                inputCols=[f"x_{c}" for c in CATEGORICAL], outputCols=[f"i_{c}" for c in CATEGORICAL], handleInvalid="keep"
            ),
            OneHotEncoder(inputCols=[f"i_{c}" for c in CATEGORICAL], outputCols=[f"h_{c}" for c in CATEGORICAL]),
            VectorAssembler(
                inputCols=[*[f"x_{c}" for c in self.columns], *[f"h_{c}" for c in CATEGORICAL]], outputCol="features"
            ),
        ]


def fit_preprocessor(train: DataFrame, surface_specific: bool = False, scaled: bool = True) -> Preprocessor:
    """Learn fills and scales; every result collected here is one row per input column."""
    columns = numeric_features(surface_specific)
    medians = {r.feature: r.median for r in exact_medians(train, columns).collect()}
    medians = {c: medians.get(c) if medians.get(c) is not None else 0.0 for c in columns}
    common = {r.feature: r.mode for r in modes(train, CATEGORICAL).collect()}
    means, deviations = {}, {}
    if scaled:
        for r in scale_statistics(impute(train, medians), columns).collect():
            means[r.feature], deviations[r.feature] = r.mean, r.std
    return Preprocessor(tuple(columns), medians, {c: common.get(c, "U") for c in CATEGORICAL}, means, deviations, scaled)
