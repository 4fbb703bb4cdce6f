"""Score text: sets won, void tokens and the K factor they lead to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from duelframe.config import RatingConfig

# fixed values
VOID_TOKENS = ("RET", "W/O", "WO", "DEF", "ABN", "UNP", "CANC")


def is_void(score: str) -> Column:
    """True when the score holds a void token anywhere; a missing score is not void."""
    text = F.upper(F.coalesce(F.col(score), F.lit("")))
    found = F.lit(False)
    for token in VOID_TOKENS:
        found = found | text.contains(token)
    return found


def set_games(token: Column) -> Column:
    """Games of one set token such as 7-6(5): every digit left of the first dash,
    and the leading digits right of it. Null fields when a side has none."""
    cut = F.instr(token, "-")
    left = F.regexp_replace(F.substring_index(token, "-", 1), "[^0-9]", "")
    right = F.regexp_extract(F.substr(token, cut + 1), "^[0-9]+", 0)
    readable = cut > 0
    return F.struct(
        F.when(readable, left.try_cast("int")).alias("first"),
        F.when(readable, right.try_cast("int")).alias("second"),
    )


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def sets_won(score: str) -> Column:
    """Struct (winner, loser) of sets won; (1, 0) when nothing can be read."""
    tokens = F.split(F.trim(F.col(score)), r"\s+")
    counts = _once(F.transform(tokens, set_games), lambda games: F.struct(
        F.size(F.filter(games, lambda g: g.first > g.second)).alias("winner"),
        F.size(F.filter(games, lambda g: g.second > g.first)).alias("loser"),
    ))
    readable = F.col(score).isNotNull() & ~is_void(score)

    def usable(n: Column) -> Column:
        found = readable & (n.winner + n.loser > 0)
        return F.struct(F.when(found, n.winner).otherwise(1).alias("winner"), F.when(found, n.loser).otherwise(0).alias("loser"))

    return _once(counts, usable)


def level_multiplier(level: str, config: RatingConfig) -> Column:
    key = F.upper(F.trim(F.col(level)))
    value = F.lit(1.0)
    for name, factor in config.step.by_level.items():
        value = F.when(key == name, F.lit(factor)).otherwise(value)
    return value


def margin_multiplier(score: str, config: RatingConfig) -> Column:
    def factor(sets: Column) -> Column:
        value = F.lit(1.0)
        for least, one in sorted(config.step.by_margin.items()):
            value = F.when(sets.winner - sets.loser >= least, F.lit(one)).otherwise(value)
        return value

    return _once(sets_won(score), factor)


def effective_k(score: str | None, level: str | None, config: RatingConfig) -> Column:
    k = F.lit(config.step.base)
    if config.step.by_level and level:
        k = k * level_multiplier(level, config)
    if config.step.by_margin and score:
        k = k * margin_multiplier(score, config)
    return k
