"""Pre-match scoring features on the wide table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.functions.coerce import optional
from duelframe.functions.probability import NEUTRAL, bound, clip, hold, match_win, set_win


def history_or_neutral(df: DataFrame, value: str, flag: str) -> Column:
    """The rate when its history flag is set, else 0.5."""
    return F.when(optional(df, flag, 0) == 1, F.coalesce(optional(df, value, NEUTRAL, "double"), F.lit(NEUTRAL))).otherwise(
        F.lit(NEUTRAL)
    )


def serve_points(df: DataFrame, clipped: bool = False) -> tuple[Column, Column]:
    """P(A wins a point on serve) and the same for B, from serve and return history."""

    def rate(kind: str, side: str) -> Column:
        name = "service" if kind == "serve" else "return"
        value = history_or_neutral(df, f"{name}_points_won_pct_30_{side}", f"has_{kind}_history_{side}")
        return clip(value) if clipped else value

    p_a = (rate("serve", "a") + (1.0 - rate("return", "b"))) / 2.0
    p_b = (rate("serve", "b") + (1.0 - rate("return", "a"))) / 2.0
    return (clip(p_a), clip(p_b)) if clipped else (p_a, p_b)


def with_prematch(df: DataFrame, p_a: Column, p_b: Column, best_of: Column, out: str) -> DataFrame:
    """Add P(A wins) before the match, averaged over who serves first.

    Each step is a column of its own: the sums use their inputs many times, and
    nesting them would copy whole expressions.
    """
    c = F.col
    staged = (
        df.select("*", clip(p_a).alias("_pa"), clip(p_b).alias("_pb"), best_of.alias("_sets"))
        .select("*", clip(hold(c("_pa"), True)).alias("_ha"), clip(hold(c("_pb"), True)).alias("_hb"))
        .select("*", *[
            clip(set_win(c("_ha"), c("_hb"), c("_pa"), c("_pb"), first, True)).alias(f"_set_{n}")
            for n, first in (("a", True), ("b", False))
        ])
        .select("*", *[match_win(c(f"_set_{n}"), c("_sets")).alias(f"_match_{n}") for n in "ab"])
    )
    return staged.select(*df.columns, bound((c("_match_a") + c("_match_b")) / 2.0).alias(out))


def scoring_features(wide: DataFrame) -> DataFrame:
    p_a, p_b = serve_points(wide)
    df = with_prematch(wide, p_a, p_b, optional(wide, "best_of", 3.0), "_win_a")

    def both(flag: str) -> Column:
        return ((optional(wide, f"{flag}_a", 0) == 1) & (optional(wide, f"{flag}_b", 0) == 1)).cast("int")

    return df.select(
        *wide.columns,
        F.coalesce(both("has_serve_history"), F.lit(0)).alias("has_serve_history"),
        F.coalesce(both("has_return_history"), F.lit(0)).alias("has_return_history"),
        F.col("_win_a").alias("markov_match_win_prob_a"),
        (1.0 - F.col("_win_a")).alias("markov_match_win_prob_b"),
        (2.0 * F.col("_win_a") - 1.0).alias("delta_markov_match_win"),
    )


def with_start_state(wide: DataFrame, out: str) -> DataFrame:
    """Scoring probability at the start of a match, with inputs rounded to four places."""
    p_a, p_b = serve_points(wide, clipped=True)
    return with_prematch(wide, F.round(p_a, 4), F.round(p_b, 4), optional(wide, "best_of", 3.0), out)
