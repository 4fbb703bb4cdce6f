"""Chronological ratings, overall and per surface.

A rating depends on the contest before it, so a pool is an ordered chain. The
chain is cut into turns of at most ``turn_rows`` contests per pool. One job
rates one turn of every pool at once, each task seeing a bounded slice and the
ratings of the players in it; the ratings then go to the next turn as a
written table. A lost executor costs one turn, and no task ever holds a pool.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.config import RatingConfig
from duelframe.functions.coerce import category_or, optional, require
from duelframe.functions.scores import effective_k, is_void
from duelframe.operators.longview import contest_id
from duelframe.operators.ordering import global_index
from duelframe.session import ship, spool

ship(__name__)

#: The last one, the row's own number, parts rows that are equal in all others.
ORDER = ("tourney_date", "tourney_id", "match_num", "match_id", "_row")
RATED = ("winner_pre", "loser_pre", "winner_post", "loser_post")
RESULT = "_row long, " + ", ".join(f"{n} double" for n in (*RATED, *[f"surface_{n}" for n in RATED]))


def win_expectancy(mine: Column, theirs: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), (theirs - mine) / F.lit(400.0)))


def surface_bucket(column: str, config: RatingConfig) -> Column:
    return category_or(column, config.surfaces, config.surfaces[0])


def _rate(rows: pd.DataFrame, seeds: pd.DataFrame | None, initial: float, weight: float) -> pd.DataFrame:
    """Rate one slice in order, starting from the given ratings."""
    overall: dict[str, float] = {}
    on_surface: dict[tuple[str, str], float] = {}
    if seeds is not None:
        for player, surface, rating in zip(seeds.player_id, seeds.surface, seeds.rating):
            if surface == "":
                overall[player] = rating
            else:
                on_surface[surface, player] = rating
    rows = rows.sort_values("_idx")
    out = []
    for row, winner, loser, surface, k, live in zip(
        rows["_row"], rows.winner_id, rows.loser_id, rows.surface, rows.k, rows.live
    ):
        a, b = overall.get(winner, initial), overall.get(loser, initial)
        sa = on_surface.get((surface, winner), weight * a + (1.0 - weight) * initial)
        sb = on_surface.get((surface, loser), weight * b + (1.0 - weight) * initial)
        gain = k * (1.0 - 1.0 / (1.0 + 10.0 ** ((b - a) / 400.0))) if live else 0.0
        surface_gain = k * (1.0 - 1.0 / (1.0 + 10.0 ** ((sb - sa) / 400.0))) if live else 0.0
        if live:
            overall[winner], overall[loser] = a + gain, b - gain
            on_surface[surface, winner], on_surface[surface, loser] = sa + surface_gain, sb - surface_gain
        out.append((row, a, b, a + gain, b - gain, sa, sb, sa + surface_gain, sb - surface_gain))
    return pd.DataFrame(out, columns=["_row", *RATED, *[f"surface_{n}" for n in RATED]])


def _ratings_after(results: DataFrame, pool: Sequence[str]) -> DataFrame:
    """Newest rating of each player, overall (surface '') and per surface."""
    per_side = F.explode(
        F.array(
            *[
                F.struct(
                    F.col(f"{side}_id").alias("player_id"),
                    surface.alias("surface"),
                    F.col(f"{prefix}{side}_post").alias("rating"),
                )
                for side in ("winner", "loser")
                for prefix, surface in (("", F.lit("")), ("surface_", F.col("surface")))
            ]
        )
    )
    return (
        results.filter("live")
        .select(*pool, "_idx", per_side.alias("s"))
        .select(*pool, "_idx", "s.*")
        .groupBy(*pool, "player_id", "surface")
        .agg(F.max_by("rating", "_idx").alias("rating"))
    )


def rate_contests(
    contests: DataFrame,
    config: RatingConfig | None = None,
    pool: Sequence[str] = ("tour",),
) -> DataFrame:
    """Add pre/post ratings, their difference and the winner's expectancy, overall and on the surface.

    Each row is one contest, whatever ids it shares with others; missing dates
    and numbers are rated last. The rows are written once with a number, by
    which their ratings come back.
    """
    config = config or RatingConfig()
    require(contests, ["tourney_date", "winner_id", "loser_id", "winner_name", "loser_name", *pool], "contests")
    has_score = "score" in contests.columns
    has_level = "tourney_level" in contests.columns
    spark = contests.sparkSession
    # what the order and the steps need is worked out once: sampled range bounds, the shuffle and the ratings read it
    needed = {
        "_event": optional(contests, "tourney_id", None, "string"),
        "_number": optional(contests, "match_num", None, "double"),
        "_match": contest_id(contests),
        "_surface": surface_bucket("surface", config) if "surface" in contests.columns else F.lit(config.surfaces[0]),
        "_k": effective_k("score" if has_score else None, "tourney_level" if has_level else None, config),
        "_live": ~is_void("score") if has_score else F.lit(True),
    }
    keyed = spool(
        contests.select("*", F.monotonically_increasing_id().alias("_row"), *[v.alias(n) for n, v in needed.items()]), "rating-rows"
    )
    narrow = keyed.select(
        *pool,
        "_row",
        "tourney_date",
        F.col("_event").alias("tourney_id"),
        F.col("_number").alias("match_num"),
        F.col("_match").alias("match_id"),
        F.col("winner_id").cast("string").alias("winner_id"),
        F.col("loser_id").cast("string").alias("loser_id"),
        F.col("_surface").alias("surface"),
        F.col("_k").alias("k"),
        F.col("_live").alias("live"),
    )
    keyed = keyed.select(*contests.columns, "_row")
    order = [c for c in ORDER]
    indexed = spool(
        global_index(narrow, order, "_idx", group=pool)
        .withColumn("_turn", F.floor(F.col("_idx") / config.turn_rows).cast("int"))
        .select(*pool, "_row", "winner_id", "loser_id", "surface", "k", "live", "_idx", "_turn"),
        "turns",
        ("_turn",),
    )
    turns = (indexed.agg(F.max("_turn")).first()[0] or 0) + 1
    initial, weight = config.start, config.surface_share

    if turns == 1:
        rated = indexed.groupBy(*pool).applyInPandas(
            lambda rows: _rate(rows, None, initial, weight), RESULT
        )
    else:
        ratings, parts = None, []
        for turn in range(turns):
            batch = indexed.filter(F.col("_turn") == turn)
            if ratings is None:
                done = batch.groupBy(*pool).applyInPandas(lambda rows: _rate(rows, None, initial, weight), RESULT)
            else:
                playing = batch.select(
                    *pool, F.explode(F.array("winner_id", "loser_id")).alias("player_id")
                ).distinct()
                seeds = ratings.join(playing, [*pool, "player_id"], "left_semi")
                done = (
                    batch.groupBy(*pool)
                    .cogroup(seeds.groupBy(*pool))
                    .applyInPandas(lambda rows, seeds: _rate(rows, seeds, initial, weight), RESULT)
                )
            done = spool(done, "rated")
            parts.append(done)
            newest = _ratings_after(batch.join(done, "_row"), pool)
            if ratings is not None:
                kept = ratings.join(newest, [*pool, "player_id", "surface"], "left_anti")
                newest = newest.unionByName(kept)
            ratings = spool(newest, "ratings")
        rated = parts[0]
        for part in parts[1:]:
            rated = rated.unionByName(part)

    named = rated.select(
        "_row",
        *[
            F.col(f"{s}{side}_{when}").alias(f"{side}_{s}elo_{when}")
            for s in ("", "surface_")
            for when in ("pre", "post")
            for side in ("winner", "loser")
        ],
    )
    out = keyed.join(named, "_row").drop("_row")
    for s in ("", "surface_"):
        mine, theirs = F.col(f"winner_{s}elo_pre"), F.col(f"loser_{s}elo_pre")
        out = out.withColumn(f"{s}elo_diff_pre", mine - theirs)
        out = out.withColumn(f"{s}elo_prob_winner_pre", win_expectancy(mine, theirs))
    if "surface" in contests.columns:
        out = out.withColumn("surface_normalized", surface_bucket("surface", config))
    return out


def rating_history(rated: DataFrame) -> DataFrame:
    """Two rows per contest: each player's rating before and after."""
    sides = F.array(
        *[
            F.struct(
                F.col("tourney_date").alias("date"),
                F.col(f"{s}_id").alias("player_id"),
                F.col(f"{s}_name").alias("player_name"),
                F.col(f"{s}_elo_pre").alias("elo_pre"),
                F.col(f"{s}_elo_post").alias("elo_post"),
            )
            for s in ("winner", "loser")
        ]
    )
    keep = [c for c in ("tour", "tourney_id", "match_num") if c in rated.columns]
    return rated.select(*keep, F.explode(sides).alias("s")).select(*keep, "s.*")
