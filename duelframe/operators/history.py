"""History features of each side before each contest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.functions.coerce import require, text_or
from duelframe.operators.prior import CHUNK_ROWS, HEAVY_ROWS, Prior, heavy_keys, prior_features

PLAYER = ("tour", "player_id")
ORDER = ("tourney_date", "tourney_id", "match_num", "match_id")
DAY = "tourney_date"
#: The same order by the number of the day, in which rows and day frames share a sort.
DAY_NUMBER = "_day_number"
BY_NUMBER = (DAY_NUMBER, *ORDER[1:])

# fixed values: names of output columns and the columns of a side that they average
LAST10 = {
    "win_rate_last10": "label_win",
    "aces_avg_last10": "aces",
    "ace_pct_last10": "aces_per_service_point",
    "df_pct_last10": "df_per_service_point",
    "first_serve_in_pct_last10": "first_serve_in_pct",
    "ace_vs_df_last10": "ace_vs_df",
    "second_serve_won_per_service_game_last10": "second_serve_won_per_service_game",
    "serve_win_pct_last10": "service_points_won_pct",
    "return_win_pct_last10": "return_points_won_pct",
    "bp_conversion_last10": "bp_conversion_pct",
    "bp_saved_pct_last10": "bp_saved_pct",
}
LAST30 = {
    "service_points_won_pct_30": ("service_points_won_pct", "has_serve_history"),
    "return_points_won_pct_30": ("return_points_won_pct", "has_return_history"),
}
SURFACE10 = {
    "surface_win_pct_last10": "label_win",
    "serve_win_pct_last10_surface": "service_points_won_pct",
    "return_win_pct_last10_surface": "return_points_won_pct",
    "bp_conversion_last10_surface": "bp_conversion_pct",
    "bp_saved_pct_last10_surface": "bp_saved_pct",
}


def roll_mean_10(window: int = 10) -> list[Prior]:
    return [Prior(out, "mean", src, "rows", window) for out, src in LAST10.items()]


def roll_mean_30() -> list[Prior]:
    out = []
    for name, (source, flag) in LAST30.items():
        out.append(Prior(name, "mean", source, "rows", 30, 10))
        out.append(Prior(f"_{flag}", "count", source, "rows", 30))
    return out


def day_counts() -> list[Prior]:
    return [Prior(f"matches_last_{n}_days", "count", None, "days", n) for n in (7, 30, 365)]


def win_share_365() -> list[Prior]:
    return [Prior("win_pct_last_365_days", "mean", "label_win", "days", 365)]


def previous_row() -> list[Prior]:
    return [
        Prior("previous_match_win", "max", "label_win", "rows", 1),
        Prior("_previous_day", "max", DAY, "rows", 1),
    ]


def streak_parts() -> list[Prior]:
    """Rows before, and rows before the last row that was not a win, counted from the start."""
    return [Prior("matches_played", "count", None, "all")]


def history_flags(df: DataFrame) -> DataFrame:
    for _, (_, flag) in LAST30.items():
        df = df.withColumn(flag, (F.col(f"_{flag}") >= 10).cast("int")).drop(f"_{flag}")
    return df


def days_since(name: str, previous: str = "_previous_day") -> Column:
    return F.datediff(F.col(DAY), F.col(previous)).cast("double").alias(name)


def with_streak(df: DataFrame, heavy: DataFrame | None, chunk_rows: int = CHUNK_ROWS, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Wins in a row before each row; a loss or a missing label ends a streak.

    The number of rows up to and including the last non-win is the largest
    ``matches_played + 1`` seen on a non-win row, so a second pass over the
    same grouping finishes the streak without any per-row code.
    """
    numbered = df if "matches_played" in df.columns else prior_features(
        df, PLAYER, order, streak_parts(), heavy=heavy, chunk_rows=chunk_rows
    )
    numbered = numbered.withColumn(
        "_broken_at",
        F.when(F.coalesce(F.col("label_win"), F.lit(0)) != 1, F.col("matches_played") + 1),
    )
    out = prior_features(
        numbered, PLAYER, order, [Prior("_broken", "max", "_broken_at", "all")],
        heavy=heavy, chunk_rows=chunk_rows,
    )
    return out.withColumn(
        "current_win_streak",
        (F.col("matches_played") - F.coalesce(F.col("_broken"), F.lit(0))).cast("double"),
    ).drop("_broken_at", "_broken")


def _group_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.upper(F.trim("surface")).alias("_surface"),
        text_or("opponent_hand", "U").alias("_hand"),
        text_or("round", "UNK").alias("_round"),
    )


def surface_measures() -> list[Prior]:
    return [
        Prior("surface_match_count", "count", None, "all"),
        *[Prior(out, "mean", src, "rows", 10, 5) for out, src in SURFACE10.items()],
        Prior("_previous_surface_day", "max", DAY, "rows", 1),
        Prior("matches_last_30_days_surface", "count", None, "days", 30),
    ]


def hand_measures(window: int = 10) -> list[Prior]:
    return [Prior("hand_win_pct_last10", "mean", "label_win", "rows", window)]


def round_measures() -> list[Prior]:
    return [Prior("round_win_pct", "mean", "label_win", "all")]


def head_to_head_measures() -> list[Prior]:
    return [
        Prior("_h2h_played", "count", None, "all"),
        Prior("_h2h_won", "sum", "label_win", "all"),
    ]


def with_head_to_head(df: DataFrame, heavy: DataFrame | None = None,
                      chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Prior wins, losses and win ratio against the same opponent (0.5 when they never met)."""
    out = prior_features(
        df, (*PLAYER, "opponent_id"), ORDER, head_to_head_measures(), heavy=heavy, chunk_rows=chunk_rows
    )
    wins = F.coalesce(F.col("_h2h_won"), F.lit(0)).cast("long")
    return out.select(
        *df.columns,
        wins.alias("h2h_wins"),
        (F.col("_h2h_played") - wins).alias("h2h_losses"),
        F.coalesce(F.try_divide(wins.cast("double"), F.col("_h2h_played")), F.lit(0.5)).alias("h2h_win_ratio"),
    )


def player_history(
    long: DataFrame,
    heavy_rows: int = HEAVY_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    window: int = 10,
) -> DataFrame:
    """All history columns. Every grouping starts with the player, so unless a
    player is heavy one shuffle by player serves all of them, and groupings by
    the same keys share a sort. Rows are sorted whole, so they should be narrow:
    :data:`INPUTS` are the columns that are needed."""
    require(long, ["player_id", DAY, "match_id", "surface", "round", "opponent_hand"], "long view")
    heavy = heavy_keys(long, PLAYER, heavy_rows)

    def add(df, keys, measures, day=None):
        return prior_features(df, keys, BY_NUMBER, measures, day=day, heavy=heavy, chunk_rows=chunk_rows)

    df = _group_columns(long).withColumn(DAY_NUMBER, F.unix_date(DAY))
    df = add(
        df,
        PLAYER,
        [*streak_parts(), *roll_mean_10(window), *roll_mean_30(), *previous_row(), *day_counts(), *win_share_365()],
        DAY_NUMBER,
    )
    df = with_streak(df, heavy, chunk_rows, BY_NUMBER)
    df = add(df, (*PLAYER, "_surface"), surface_measures(), DAY_NUMBER)
    df = add(df, (*PLAYER, "_hand"), hand_measures(window))
    df = add(df, (*PLAYER, "_round"), round_measures())
    df = with_head_to_head(df, heavy, chunk_rows)
    df = history_flags(df).select(
        "*",
        days_since("days_since_last_match"),
        days_since("days_since_last_match_surface", "_previous_surface_day"),
        (F.col("surface_match_count") >= 5).cast("int").alias("has_surface_history"),
    )
    return df.drop("_surface", "_hand", "_round", "_previous_day", "_previous_surface_day", DAY_NUMBER)


def _named(measures: list[Prior]) -> list[str]:
    return [m.out for m in measures if not m.out.startswith("_")]


#: What each player's earlier contests say, by the measures above.
HISTORY = (
    *_named([*streak_parts(), *roll_mean_10(), *win_share_365(), *previous_row(), *day_counts()]), "current_win_streak",
    "days_since_last_match", *_named([m for m in surface_measures() if m.agg == "mean" or m.frame == "days"]),
    "days_since_last_match_surface", *_named([*hand_measures(), *round_measures()]), "h2h_wins", "h2h_losses",
)
#: Shares that only count with enough history behind them, and the marks that say so.
GUARDED = (*LAST30, *(flag for _, flag in LAST30.values()), "has_surface_history")
#: Columns of the long view that the history is made of.
INPUTS = tuple(dict.fromkeys([
    *PLAYER, *ORDER, "surface", "round", "opponent_hand", "opponent_id", "label_win",
    *[m.source for m in (*roll_mean_10(), *roll_mean_30(), *surface_measures()) if m.source],
]))
