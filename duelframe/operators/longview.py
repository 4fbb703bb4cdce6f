"""Two rows per contest, one from each side, with serve and return ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.functions.coerce import optional, to_double

SIDE_FIELDS = (
    "id", "name", "hand", "ht", "age", "rank", "rank_points", "seed",
    "elo_pre", "elo_post", "surface_elo_pre", "surface_elo_post",
)
TEXT_FIELDS = {"id", "name", "hand", "seed"}
BOX_FIELDS = {
    "aces": "ace", "double_faults": "df", "serve_points": "svpt", "first_in": "1stIn",
    "first_won": "1stWon", "second_won": "2ndWon", "service_games": "SvGms",
    "break_points_saved": "bpSaved", "break_points_faced": "bpFaced",
}
RETURN_FIELDS = [f for f in BOX_FIELDS if f not in ("aces", "double_faults")]
SHARED_TEXT = ("tourney_id", "tourney_name", "surface", "round")

RATIOS = (
    "first_serve_in_pct", "first_serve_won_pct", "second_serve_attempts", "second_serve_won_pct",
    "second_serve_won_per_service_game", "aces_per_service_point", "df_per_service_point",
    "ace_vs_df", "bp_saved_pct", "service_points_won", "service_points_won_pct",
    "opponent_service_points_won", "return_points_won", "return_points_won_pct",
    "break_points_converted", "bp_conversion_pct", "elo_diff_pre", "surface_elo_diff_pre",
)


def contest_id(df: DataFrame) -> Column:
    """Deterministic contest id from event and number, or from descriptive columns."""
    parts = (
        ["tourney_id", "match_num"]
        if {"tourney_id", "match_num"} <= set(df.columns)
        else ["tourney_date", "tourney_name", "round", "winner_id", "loser_id"]
    )
    return F.concat_ws(
        "__", *[F.coalesce(optional(df, p, "").cast("string"), F.lit("")) for p in parts]
    )


def _sides(df: DataFrame, won: Column) -> list[Column]:
    """Columns of the winner's side where ``won``, else those of the loser's."""

    def either(of_winner: tuple[str, str], of_loser: tuple[str, str], out: str, text: bool = False) -> Column:
        kind = "string" if text else "double"
        cells = [optional(df, f"{side}_{field}", None, kind) for side, field in (of_winner, of_loser)]
        mine, theirs = [c.cast("string") if text else to_double(c) for c in cells]
        return F.when(won, mine).otherwise(theirs).alias(out)

    def person(prefix: str, first: str, second: str) -> list[Column]:
        return [either((first, f), (second, f), f"{prefix}_{f}", f in TEXT_FIELDS) for f in SIDE_FIELDS]

    label = F.when(won, 1).otherwise(0)
    return [
        *person("player", "winner", "loser"),
        *person("opponent", "loser", "winner"),
        label.alias("is_winner"),
        label.alias("label_win"),
        *[either(("w", s), ("l", s), f) for f, s in BOX_FIELDS.items()],
        *[either(("l", BOX_FIELDS[f]), ("w", BOX_FIELDS[f]), f"opponent_{f}") for f in RETURN_FIELDS],
    ]


def long_view(contests: DataFrame) -> DataFrame:
    """One scan of the contests; each row counts twice, and only columns that are asked for are worked out."""
    shared = [
        contest_id(contests).alias("match_id"),
        optional(contests, "tour", None, "string").alias("tour"),
        *[optional(contests, c, None, "string").alias(c) for c in SHARED_TEXT],
        optional(contests, "tourney_level", "U").alias("tourney_level"),
        optional(contests, "tourney_date", None, "date").alias("tourney_date"),
        to_double(optional(contests, "match_num", None, "double")).alias("match_num"),
        to_double(optional(contests, "best_of", None, "double")).alias("best_of"),
        to_double(optional(contests, "minutes", None, "double")).alias("minutes"),
    ]
    twice = contests.withColumn("_won", F.explode(F.array(F.lit(True), F.lit(False))))
    return serve_return_rates(twice.select(*shared, *_sides(contests, F.col("_won"))))


def serve_return_rates(sides: DataFrame) -> DataFrame:
    """Ratios of the box score; a zero denominator gives null."""
    c = F.col
    second_tries = c("serve_points") - c("first_in")
    won_on_serve = c("first_won") + c("second_won")
    rival_serve = c("opponent_first_won") + c("opponent_second_won")
    won_on_return = c("opponent_serve_points") - rival_serve
    converted = c("opponent_break_points_faced") - c("opponent_break_points_saved")
    ratio = F.try_divide
    values = {
        "first_serve_in_pct": ratio(c("first_in"), c("serve_points")),
        "first_serve_won_pct": ratio(c("first_won"), c("first_in")),
        "second_serve_attempts": second_tries,
        "second_serve_won_pct": ratio(c("second_won"), second_tries),
        "second_serve_won_per_service_game": ratio(c("second_won"), c("service_games")),
        "aces_per_service_point": ratio(c("aces"), c("serve_points")),
        "df_per_service_point": ratio(c("double_faults"), c("serve_points")),
        "ace_vs_df": ratio(c("aces"), c("double_faults")),
        "bp_saved_pct": ratio(c("break_points_saved"), c("break_points_faced")),
        "service_points_won": won_on_serve,
        "service_points_won_pct": ratio(won_on_serve, c("serve_points")),
        "opponent_service_points_won": rival_serve,
        "return_points_won": won_on_return,
        "return_points_won_pct": ratio(won_on_return, c("opponent_serve_points")),
        "break_points_converted": converted,
        "bp_conversion_pct": ratio(converted, c("opponent_break_points_faced")),
        "elo_diff_pre": c("player_elo_pre") - c("opponent_elo_pre"),
        "surface_elo_diff_pre": c("player_surface_elo_pre") - c("opponent_surface_elo_pre"),
    }
    return sides.select("*", *[v.alias(n) for n, v in values.items()])
