"""From raw contest rows to processed contests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe.functions.coerce import category_upper, coerce_numeric, parse_yyyymmdd, to_double
from duelframe.operators.ordering import global_index
from duelframe.sources.files import survey_csv, yearly_files

_PERSON = ("id", "seed", "entry", "name", "hand", "ht", "ioc", "age", "rank", "rank_points")
_BOX = ("ace", "df", "svpt", "1stIn", "1stWon", "2ndWon", "SvGms", "bpSaved", "bpFaced")
# fixed values: column names of public contest files
CONTEST_COLUMNS = (
    "tourney_id", "tourney_name", "surface", "draw_size", "tourney_level", "tourney_date", "match_num",
    *[f"winner_{f}" for f in _PERSON],
    *[f"loser_{f}" for f in _PERSON],
    "score", "best_of", "round", "minutes",
    *[f"{side}_{f}" for side in "wl" for f in _BOX],
)
# fixed values: other names a source may use, tried in order after the name itself
ALTERNATIVES = {
    "tourney_id": ("tournament_id",),
    "tourney_name": ("tournament", "tournament_name"),
    "draw_size": ("draw",),
    "tourney_level": ("level",),
    "tourney_date": ("date",),
    "match_num": ("match_id",),
    "winner_id": ("winner_player_id",),
    "winner_name": ("winner",),
    "winner_ht": ("winner_height",),
    "winner_ioc": ("winner_country",),
    "loser_id": ("loser_player_id",),
    "loser_name": ("loser",),
    "loser_ht": ("loser_height",),
    "loser_ioc": ("loser_country",),
    "minutes": ("mins",),
    **{f"{s}_{f}": (f"{s}_{f}".lower(),) for s in "wl" for f in _BOX if f != f.lower()},
}
NUMERIC_COLUMNS = (
    "draw_size", "match_num", "best_of", "minutes",
    *[f"{who}_{f}" for who in ("winner", "loser") for f in ("seed", "ht", "age", "rank", "rank_points")],
    *[f"{side}_{f}" for side in "wl" for f in _BOX],
)


def harmonise(df: DataFrame, source: str, season: int | None = None) -> DataFrame:
    """The 49 contest columns: the first known name that exists, else null. The
    choice is made from the schema, so it costs nothing at run time."""
    # names are matched by case here, unlike in Spark's resolver
    columns = []
    for target in CONTEST_COLUMNS:
        name = next((n for n in (target, *ALTERNATIVES.get(target, ())) if n in df.columns), None)
        columns.append((F.col(name) if name else F.lit(None).cast("string")).alias(target))
    extra = [F.lit(source).alias("data_source")]
    if season is not None:
        extra.append(F.lit(season).alias("season"))
    elif "season" in df.columns:
        extra.append(F.col("season"))
    return df.select(*columns, *extra).dropna(subset=["winner_name", "loser_name"])


def drop_voided(df: DataFrame, walkovers: bool = True, retirements: bool = True) -> DataFrame:
    """Leave out walkovers and retirements; a missing score stays."""
    text = F.upper(F.coalesce(F.col("score"), F.lit("")))
    keep = F.lit(True)
    if walkovers:
        keep = keep & ~text.contains("W/O")
    if retirements:
        keep = keep & ~text.contains("RET")
    return df.filter(keep)


def within_dates_of(df: DataFrame, reference: DataFrame | None, date: str = "tourney_date") -> DataFrame:
    """Rows inside the date range of another table; without one, everything.

    The range is one row read from one column, and becomes a pushed-down filter.
    """
    if reference is None:
        return df
    low, high = reference.agg(F.min(date), F.max(date)).first()
    if low is None:
        raise ValueError("reference table has no valid dates")
    return df.filter(F.col(date).between(F.lit(low), F.lit(high)))


def fill_sequence_number(
    df: DataFrame, order: Sequence[str], number: str = "match_num",
    group: Sequence[str] = ("season", "tourney_id"), start: int = 100_000,
) -> DataFrame:
    """Give rows without a number ``start``, ``start + 1``, … within their event."""
    valued = df.withColumn(number, to_double(number).cast("long"))
    missing = global_index(valued.filter(F.col(number).isNull()), order, "_n", group=group)
    filled = missing.withColumn(number, F.col("_n") + start).drop("_n")
    return valued.filter(F.col(number).isNotNull()).unionByName(filled)


def process_contests(raw: DataFrame, walkovers: bool = True, retirements: bool = True) -> DataFrame:
    """Parse dates, settle the surface spelling, read numbers, drop voided contests."""
    typed = coerce_numeric(raw, NUMERIC_COLUMNS).withColumns(
        {"tourney_date": parse_yyyymmdd("tourney_date"), "surface": category_upper("surface")}
    )
    return drop_voided(typed, walkovers, retirements)


#: Order in which contests without a number are numbered within their event.
NUMBERING = ("tourney_date", "winner_id", "loser_id", "winner_name", "loser_name", "score", "round", "minutes")


def build_from_years(
    spark: SparkSession, root: str, years: Sequence[int], source: str, reference: DataFrame | None = None,
    year: str = r"(\d{4})\.csv$", walkovers: bool = True, retirements: bool = True, numbering: Sequence[str] = NUMBERING,
) -> tuple[DataFrame, list[int]]:
    """Processed contests of another source's yearly files in order of their dates, and the years without a file.

    Each kind of header is harmonised by itself, as files of one source name
    their columns differently over the years; contests outside of the dates of
    ``reference`` are left out, and missing numbers are filled last.
    """
    paths, missing = yearly_files(spark, root, years, year)
    out = None
    for (header, encoding), group in survey_csv(spark, paths).items():
        text = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in header]))
        read = text.option("header", True).option("encoding", encoding).csv(group)
        season = F.regexp_extract("_metadata.file_path", year, 1).try_cast("int")
        part = harmonise(read.drop("season").withColumn("season", season), source)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise FileNotFoundError(f"only empty files in {root}")
    kept = within_dates_of(process_contests(out, walkovers, retirements), reference)
    return fill_sequence_number(kept, list(numbering)).orderBy("tourney_date"), missing
