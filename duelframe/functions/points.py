"""Point labels, tiebreak flags and who wins from a final point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duelframe.functions.coerce import to_long

# fixed values
POINT_LABELS = {"0": 0, "LOVE": 0, "15": 1, "30": 2, "40": 3, "A": 4, "AD": 4, "ADV": 4, "ADVANTAGE": 4}
GAME_LABELS = ("0", "15", "30", "40", "A", "AD", "ADV")


def label_count(label: Column) -> Column:
    """Points behind a label; null and blank are 0, other whole numbers pass, the rest is null."""
    text = F.upper(F.trim(label.cast("string")))
    known = F.create_map(*[F.lit(x) for pair in POINT_LABELS.items() for x in pair])
    return F.when(text.isNull() | (text == ""), 0).otherwise(
        F.coalesce(F.try_element_at(known, text), text.try_cast("int"))
    )


def split_points(score: Column, server: Column) -> Column:
    """Struct (first, second) of labels in player order. The text is server first;
    anything but ``x-y`` is 0-0."""
    parts = F.split(F.upper(F.trim(score)), "-")
    usable = F.coalesce(F.size(parts) == 2, F.lit(False))

    def part(i: int) -> Column:
        text = F.trim(F.try_element_at(parts, F.lit(i)))
        return F.when(usable & (text != ""), text).otherwise("0")

    swap = F.coalesce(server != 1, F.lit(False))
    return F.struct(
        F.when(swap, part(2)).otherwise(part(1)).alias("first"),
        F.when(swap, part(1)).otherwise(part(2)).alias("second"),
    )


def point_count(label: Column, tiebreak: Column) -> Column:
    """Points behind a label of a point table; unreadable labels, and advantage in a tiebreak, are 0."""
    in_tiebreak = tiebreak & label.isin("A", "AD", "ADV")
    known = F.when(label.isin("ADVANTAGE"), F.lit(None)).otherwise(label_count(label))
    return F.when(in_tiebreak, 0).otherwise(F.coalesce(known, to_long(label).cast("int"), F.lit(0)))


def match_winner(p: Column) -> Column:
    """Winner (1 or 2) of the match when the point in struct ``p`` ends it, else null.

    ``p`` has winner, tiebreak, points_1/2 (counts), games_1/2, sets_1/2, best_of.
    """
    one = p.winner == 1
    gain_1, gain_2 = F.when(one, 1).otherwise(0), F.when(one, 0).otherwise(1)
    pts_1, pts_2 = p.points_1 + gain_1, p.points_2 + gain_2
    needed = F.when(p.tiebreak, 7).otherwise(4)
    game_over = (F.greatest(pts_1, pts_2) >= needed) & (F.abs(pts_1 - pts_2) >= 2)
    g_1, g_2 = p.games_1 + gain_1, p.games_2 + gain_2
    set_winner = (
        F.when(p.tiebreak & (g_1 == 7) & (g_2 == 6), 1)
        .when(p.tiebreak & (g_2 == 7) & (g_1 == 6), 2)
        .when((g_1 >= 6) & (g_1 - g_2 >= 2), 1)
        .when((g_2 >= 6) & (g_2 - g_1 >= 2), 2)
    )
    s_1 = p.sets_1 + F.when(set_winner == 1, 1).otherwise(0)
    s_2 = p.sets_2 + F.when(set_winner == 2, 1).otherwise(0)
    target = F.floor(p.best_of / 2) + 1
    ended = p.winner.isin(1, 2) & game_over & set_winner.isNotNull()
    return F.when(ended & (s_1 >= target), 1).when(ended & (s_2 >= target), 2).cast("long")
