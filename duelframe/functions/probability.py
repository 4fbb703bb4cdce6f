"""Scoring probabilities as Column expressions.

Games and matches are short polynomials in generated code; tiebreaks and sets
are grids (:mod:`duelframe.functions.grids`) in Arrow functions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe.functions import grids
from duelframe.functions.grids import EDGE, NEUTRAL
from duelframe.session import ship

ship(__name__)

# fixed value
PRIOR_STRENGTH = 48.0


def clip(p: Column) -> Column:
    """Into [0.01, 0.99]; missing counts as 0.5 (least and greatest would skip a null)."""
    return F.when(p.isNull(), F.lit(NEUTRAL)).otherwise(F.least(F.greatest(p, F.lit(EDGE)), F.lit(1.0 - EDGE)))


def bound(p: Column) -> Column:
    return F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def power(x: Column, n: int) -> Column:
    """x to a small whole power by squaring, cheaper than pow()."""
    if n == 0:
        return F.lit(1.0)
    half = power(x, n // 2)
    whole = half if n == 1 else half * half
    return x * whole if n % 2 and n > 1 else (x if n == 1 else whole)


def hold(p: Column, clipped: bool = False) -> Column:
    """P(server wins a game) from P(server wins a point)."""
    if not clipped:
        p = clip(p)
    up = power(p, 4) * (15.0 - 34.0 * p + 28.0 * power(p, 2) - 8.0 * power(p, 3))
    return bound(up / (1.0 - 2.0 * p + 2.0 * power(p, 2)))


@F.pandas_udf(T.DoubleType())
def _tiebreak(p_a: pd.Series, p_b: pd.Series, opener: pd.Series) -> pd.Series:
    grid = grids.tiebreak_grid(p_a.to_numpy(float), p_b.to_numpy(float))[:, 0, 0]
    return pd.Series(np.where(opener == 0, grid[0], grid[1]))


@F.pandas_udf(T.DoubleType())
def _set_win(hold_a: pd.Series, hold_b: pd.Series, p_a: pd.Series, p_b: pd.Series, server: pd.Series) -> pd.Series:
    tiebreaks = grids.tiebreak_grid(p_a.to_numpy(float), p_b.to_numpy(float))[:, 0, 0]
    ends = grids.set_grid(hold_a.to_numpy(float), hold_b.to_numpy(float), tiebreaks)[0, 0]
    won = ends[:, 0] + ends[:, 1]
    return pd.Series(np.where(server == 0, won[0], won[1]))


def tiebreak(p_a: Column, p_b: Column, a_first: bool, clipped: bool = False) -> Column:
    """P(A wins a tiebreak) from 0-0, truncated at 60 points."""
    if not clipped:
        p_a, p_b = clip(p_a), clip(p_b)
    return bound(_tiebreak(p_a, p_b, F.lit(0 if a_first else 1)))


def set_win(
    hold_a: Column, hold_b: Column, p_a: Column, p_b: Column, a_first: bool, clipped: bool = False
) -> Column:
    """P(A wins a set) from 0-0 with a tiebreak at 6-6."""
    if not clipped:
        hold_a, hold_b, p_a, p_b = clip(hold_a), clip(hold_b), clip(p_a), clip(p_b)
    return bound(_set_win(hold_a, hold_b, p_a, p_b, F.lit(0 if a_first else 1)))


def match_win(set_prob: Column, best_of: Column) -> Column:
    """P(A wins the match) when sets are alike; anything but five sets counts as three."""
    s = clip(set_prob)
    long_match = F.coalesce(best_of.try_cast("int") == 5, F.lit(False))
    three = power(s, 2) * (3.0 - 2.0 * s)
    five = power(s, 3) * (10.0 - 15.0 * s + 6.0 * power(s, 2))
    return bound(F.when(long_match, five).otherwise(three))


def count_problem(won: Column, played: Column) -> Column:
    """Why observed counts cannot be used, or null."""
    return F.when((won < 0) | (played < 0), F.lit("negative count")).when(won > played, F.lit("won exceeds played"))


def shrink(prior: Column, won: Column, played: Column, strength: float = PRIOR_STRENGTH) -> Column:
    """Serve-point probability after ``won`` of ``played``, pulled to the prior; null for impossible counts."""
    if strength < 0:
        raise ValueError("prior strength cannot be negative")
    prior, won, played = clip(prior), F.coalesce(won, F.lit(0)), F.coalesce(played, F.lit(0))
    value = F.try_divide(strength * prior + won, strength + played)
    return F.when(count_problem(won, played).isNull(), clip(F.coalesce(value, prior)))
