"""Match-win probability from a live score, for whole tables of states.

The grids of :mod:`duelframe.functions.grids` are filled for a batch of rows at a
time inside one Arrow function; a state then looks its score up. Nothing is
joined or shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe.functions.points import label_count
from duelframe.functions.grids import (
    EDGE, NEUTRAL, SIDES, TIEBREAK_LIMIT, game_grid, hold_chance, match_grid, set_grid, tiebreak_grid, two_clear,
)
from duelframe.functions.probability import clip
from duelframe.session import ship

ship(__name__)

#: Rows whose grids are filled at once.
ROWS = 4096
def win_chance(
    pa: np.ndarray, pb: np.ndarray, sets: tuple[np.ndarray, np.ndarray], games: tuple[np.ndarray, np.ndarray],
    points: tuple[np.ndarray, np.ndarray], server: np.ndarray, target: np.ndarray,
) -> np.ndarray:
    """P(A wins the match) of valid states; server is 0 for A and 1 for B."""
    row = np.arange(len(pa))
    tiebreak = tiebreak_grid(pa, pb)
    ends = set_grid(hold_chance(pa), hold_chance(pb), tiebreak[:, 0, 0])
    match = match_grid(ends[0, 0])
    need_a, need_b = target - sets[0], target - sets[1]
    over = (need_a <= 0) | (need_b <= 0)
    at_a, at_b = np.clip(need_a, 1, 3), np.clip(need_b, 1, 3)
    # value after this set, by who serves first in the next one
    won = [match[at_a - 1, at_b, t, row] for t in SIDES]
    lost = [match[at_a, at_b - 1, t, row] for t in SIDES]
    other = 1 - server

    def next_set(wins: bool, first: np.ndarray) -> np.ndarray:
        value = won if wins else lost
        return np.where(first == 0, value[0], value[1])

    def rest_of_set(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Value with the game over at x-y and the other player to serve."""
        inside = (np.maximum(x, y) < 6) | (np.abs(x - y) < 2)
        end = ends[np.minimum(x, 6), np.minimum(y, 6), other, :, row]
        open_ = end[:, 0] * won[0] + end[:, 1] * won[1] + end[:, 2] * lost[0] + end[:, 3] * lost[1]
        return np.where(inside, open_, np.where(x > y, next_set(True, other), next_set(False, other)))

    a, b = points
    point = np.where(server == 0, pa, 1 - pb)  # P(A wins the next point)
    deuce = point**2 / (point**2 + (1 - point) ** 2)
    both = (a >= 3) & (b >= 3)
    game = np.select(
        [(a >= 4) & (a - b >= 2), (b >= 4) & (b - a >= 2), both & (a == b), both & (a > b), both],
        [1.0, 0.0, deuce, point + (1 - point) * deuce, point * deuce],
        game_grid(point)[np.minimum(a, 3), np.minimum(b, 3), row],
    )
    in_game = game * rest_of_set(games[0] + 1, games[1]) + (1 - game) * rest_of_set(games[0], games[1] + 1)

    played, ahead = a + b, a - b
    opens = (played == 0) | ((played - 1) // 2 % 2 == 1)
    opener = np.where(opens, server, other)
    level = two_clear(pa * (1 - pb), (1 - pa) * pb, np.maximum(0.0, (TIEBREAK_LIMIT - played - np.abs(ahead)) / 2))
    chance = np.select(
        [(a >= 7) & (ahead >= 2), (b >= 7) & (ahead <= -2), (a < 6) | (b < 6), played >= TIEBREAK_LIMIT, ahead == 0, ahead == 1],
        [1.0, 0.0, tiebreak[opener, np.minimum(a, 6), np.minimum(b, 6), row], NEUTRAL, level, point + (1 - point) * level],
        point * level,
    )
    in_tiebreak = chance * next_set(True, 1 - opener) + (1 - chance) * next_set(False, 1 - opener)
    value = np.where((games[0] == 6) & (games[1] == 6), in_tiebreak, in_game)
    return np.clip(np.where(over, np.where(need_a <= 0, 1.0, 0.0), value), 0.0, 1.0)


@F.pandas_udf(T.DoubleType())
def _win_chance(
    pa: pd.Series, pb: pd.Series, sa: pd.Series, sb: pd.Series, ga: pd.Series, gb: pd.Series,
    ca: pd.Series, cb: pd.Series, serves: pd.Series, target: pd.Series,
) -> pd.Series:
    p = [np.clip(x.to_numpy(float), EDGE, 1 - EDGE) for x in (pa, pb)]
    n = [x.to_numpy(np.int64) for x in (sa, sb, ga, gb, ca, cb, serves, target)]
    out = np.empty(len(pa))
    for first in range(0, len(out), ROWS):
        k = slice(first, first + ROWS)
        out[k] = win_chance(p[0][k], p[1][k], (n[0][k], n[1][k]), (n[2][k], n[3][k]), (n[4][k], n[5][k]), n[6][k], n[7][k])
    return pd.Series(out)


def problem(df_cols: dict[str, Column]) -> Column:
    """Why a state cannot be scored, or null."""
    c = df_cols
    smallest = F.least(*[c[n] for n in ("sets_a", "sets_b", "games_a", "games_b", "count_a", "count_b")])
    return (
        F.when(c["count_a"].isNull() | c["count_b"].isNull(), "unreadable points")
        .when(~F.coalesce(c["server"].isin("A", "B"), F.lit(False)), "unknown server")
        .when(smallest < 0, "negative score")
        .when(F.greatest(c["sets_a"], c["sets_b"]) > c["target"], "too many sets")
        .when(F.greatest(c["games_a"], c["games_b"]) > 6, "set already over")
    )


def score_states(
    states: DataFrame, sets=("sets_a", "sets_b"), games=("games_a", "games_b"), points=("points_a", "points_b"),
    server: str = "server", p=("p_a", "p_b"), best_of: str = "best_of", out: str = "prob_a",
) -> DataFrame:
    """Add P(A wins the match) and ``<out>_problem`` for states that cannot be scored.

    A tiebreak is played at 6-6 in every set. States with a missing set or game
    count have no probability.
    """
    c = F.col
    best = F.coalesce(c(best_of).try_cast("int"), F.lit(3))
    df = states.select(
        "*",
        *[c(x).cast("int").alias(f"_{n}") for n, x in zip(("sa", "sb", "ga", "gb"), (*sets, *games))],
        label_count(c(points[0])).cast("int").alias("_ca"), label_count(c(points[1])).cast("int").alias("_cb"),
        F.upper(F.trim(server)).alias("_s"), F.when(best == 5, 3).otherwise(2).alias("_target"),
    )
    df = df.withColumn("_why", problem({
        "sets_a": c("_sa"), "sets_b": c("_sb"), "games_a": c("_ga"), "games_b": c("_gb"),
        "count_a": c("_ca"), "count_b": c("_cb"), "server": c("_s"), "target": c("_target"),
    }))
    numbers = ("_sa", "_sb", "_ga", "_gb", "_ca", "_cb")
    valid = c("_why").isNull()
    for name in numbers:
        valid = valid & c(name).isNotNull()
    # what cannot be scored runs as a new match and is set to null afterwards
    df = df.withColumn("_prob", _win_chance(
        clip(c(p[0]).cast("double")), clip(c(p[1]).cast("double")),
        *[F.when(valid, c(name)).otherwise(0) for name in numbers],
        F.when(valid & (c("_s") == "B"), 1).otherwise(0), c("_target"),
    ))
    return df.select(*states.columns, F.when(valid, c("_prob")).alias(out), c("_why").alias(f"{out}_problem"))
