"""Common opponents of the two sides before a date.

Contests are edges between players, so a common opponent closes a triangle.
Every player has a list of the players met. The list of one side travels to the
other side's as short hashes, what both hold travels back, and the meetings with
these few are compared in place: a pair stays one row, and no row stands for a
candidate. Players of very many contests have no list; their pairs are expanded
over the opponents of the player who has fewer, and looked up in the other's
meetings. Both plans give the same values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.operators.prior import heavy_keys

#: Contests of a player beyond which there is no list.
LIST_ROWS = 1024
SIDES = ("tour", "player_id_a", "player_id_b")


def meetings(long: DataFrame) -> DataFrame:
    """One row per player and opponent; the days they met as an array (bounded by the calendar)."""
    # both aggregations need this one shuffle
    return (
        long.filter("opponent_id is not null and tourney_date is not null")
        .select("tour", "player_id", "opponent_id", "tourney_date", "label_win")
        .repartition("tour", "player_id", "opponent_id")
        .groupBy("tour", "player_id", "opponent_id", "tourney_date")
        .agg(F.count(F.lit(1)).alias("played"), F.sum("label_win").alias("won"))
        .groupBy("tour", "player_id", "opponent_id")
        .agg(F.collect_list(F.struct("tourney_date", "played", "won")).alias("met"))
    )


def _until(met: Column, field: str, day: Column) -> Column:
    return F.aggregate(F.filter(met, lambda m: m.tourney_date < day), F.lit(0).cast("long"), lambda total, m: total + m[field])


def _before(met: str, field: str, day: str) -> Column:
    return _until(F.col(met), field, F.col(day))


def _asked(pairs: DataFrame, also: Sequence[str]) -> DataFrame:
    """One row per two sides; what is asked of them is a day and the columns of ``also``."""
    return pairs.groupBy(*SIDES).agg(F.collect_set(F.struct("tourney_date", *also)).alias("days"))


def _summary(counted: DataFrame, also: Sequence[str]) -> DataFrame:
    """The three summary columns from what the sides played and won against their common opponents."""
    return counted.select(
        "tour", "player_id_a", "player_id_b", "tourney_date", *also, "common_opp_count",
        (F.col("won_a") / F.col("played_a") - F.col("won_b") / F.col("played_b")).alias("delta_common_opp_win_pct"),
        (F.col("played_a") - F.col("played_b")).cast("double").alias("delta_common_opp_matches"),
    )


def _by_lookup(pairs: DataFrame, edges: DataFrame, also: Sequence[str]) -> DataFrame:
    """Expand every pair over the opponents of the side that has fewer."""
    degree = edges.groupBy("tour", "player_id").agg(F.count(F.lit(1)).alias("degree"))
    asked = (
        _asked(pairs, also)
        .withColumn("last_day", F.array_max("days.tourney_date"))
        .join(degree.toDF("tour", "player_id_a", "degree_a"), ["tour", "player_id_a"])
        .join(degree.toDF("tour", "player_id_b", "degree_b"), ["tour", "player_id_b"])
    )
    from_a = F.col("degree_a") <= F.col("degree_b")
    asked = asked.select(
        *SIDES, "days", "last_day",
        from_a.alias("from_a"),
        F.when(from_a, F.col("player_id_a")).otherwise(F.col("player_id_b")).alias("small"),
        F.when(from_a, F.col("player_id_b")).otherwise(F.col("player_id_a")).alias("large"),
    )
    candidates = asked.join(
        edges.toDF("tour", "small", "opponent_id", "met_small"), ["tour", "small"]
    ).filter(F.exists("met_small", lambda m: m.tourney_date < F.col("last_day")))
    shared = candidates.join(
        edges.toDF("tour", "large", "opponent_id", "met_large"), ["tour", "large", "opponent_id"]
    )
    counted = (
        shared.withColumn("day", F.explode("days"))
        .select(
            *SIDES, "day", "from_a",
            *[
                _before(f"met_{side}", field, "day.tourney_date").alias(f"{field}_{side}")
                for side in ("small", "large")
                for field in ("played", "won")
            ],
        )
        .filter("played_small > 0 and played_large > 0")
    )

    def of(field: str, a: bool) -> Column:
        own, other = ("small", "large") if a else ("large", "small")
        return F.sum(F.when(F.col("from_a"), F.col(f"{field}_{own}")).otherwise(F.col(f"{field}_{other}")))

    return _summary(counted.groupBy(*SIDES, *[F.col(f"day.{c}").alias(c) for c in ("tourney_date", *also)]).agg(
        F.count(F.lit(1)).cast("double").alias("common_opp_count"),
        of("played", True).alias("played_a"), of("won", True).alias("won_a"),
        of("played", False).alias("played_b"), of("won", False).alias("won_b"),
    ), also)


def _held(near: str, both: Column) -> Column:
    """Entries of a list whose hash both sides hold, without the hash."""
    found = F.filter(F.col(near), lambda m: F.array_contains(both, m.hash))
    return F.transform(found, lambda m: F.struct(m.opponent_id.alias("opponent_id"), m.met.alias("met")))


def _by_lists(pairs: DataFrame, edges: DataFrame, also: Sequence[str]) -> DataFrame:
    """Compare the sides' lists, which are sorted by hash and opponent."""
    entry = F.struct(F.hash("opponent_id").alias("hash"), "opponent_id", "met")
    lists = edges.groupBy("tour", "player_id").agg(F.sort_array(F.collect_list(entry)).alias("near"))
    hashes = F.col("near.hash")
    sent = _asked(pairs, also).join(lists.select("tour", F.col("player_id").alias("player_id_a"), hashes.alias("sent")), ["tour", "player_id_a"])
    there = sent.join(
        lists.select("tour", F.col("player_id").alias("player_id_b"), "near", hashes.alias("own")), ["tour", "player_id_b"]
    ).select(*SIDES, "days", "near", F.array_intersect("sent", "own").alias("both")).filter(F.size("both") > 0)
    back = there.select(*SIDES, "days", "both", _held("near", F.col("both")).alias("of_b")).join(
        lists.select("tour", F.col("player_id").alias("player_id_a"), "near"), ["tour", "player_id_a"]
    ).select(*SIDES, "days", "of_b", _held("near", F.col("both")).alias("of_a"))
    # in one order on both sides, unless different opponents share a hash
    in_line = F.zip_with("of_a", "of_b", lambda a, b: F.struct(a.met.alias("a"), b.met.alias("b")))
    searched = F.flatten(F.transform("of_a", lambda a: F.transform(
        F.filter("of_b", lambda b: b.opponent_id == a.opponent_id), lambda b: F.struct(a.met.alias("a"), b.met.alias("b")))))
    shared = F.when(F.col("of_a.opponent_id") == F.col("of_b.opponent_id"), in_line).otherwise(searched)
    day = F.col("tourney_date")
    counts = F.transform(shared, lambda m: F.struct(*[
        _until(m[side], field, day).alias(f"{field}_{side}") for side in "ab" for field in ("played", "won")
    ]))
    counted = back.withColumn("day", F.explode("days")).select("*", "day.*").select(
        *SIDES, "tourney_date", *also, F.filter(counts, lambda m: (m.played_a > 0) & (m.played_b > 0)).alias("counts")
    ).filter(F.size("counts") > 0)

    def added(name: str) -> Column:
        """Null if there are no values, as a sum over rows is."""
        known = F.filter(F.col(f"counts.{name}"), lambda v: v.isNotNull())
        return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0).cast("long"), lambda total, v: total + v)).alias(name)

    return _summary(counted.select(
        *SIDES, "tourney_date", *also, F.size("counts").cast("double").alias("common_opp_count"),
        *[added(f"{field}_{side}") for side in "ab" for field in ("played", "won")],
    ), also)


def common_opponents(pairs: DataFrame, long: DataFrame, list_rows: int = LIST_ROWS, also: Sequence[str] = ()) -> DataFrame:
    """Summary per distinct (tour, player_id_a, player_id_b, tourney_date, columns of ``also``) that has any.

    Pairs without common opponents are absent; callers fill zeros. Players of
    more than ``list_rows`` contests have no list.
    """
    edges = meetings(long)
    busy = heavy_keys(long, ["tour", "player_id"], list_rows)  # at most rows / list_rows of them
    if busy is None:
        return _by_lists(pairs, edges, also)
    busy = F.broadcast(busy)
    marked = pairs
    for side in "ab":
        named = busy.select("tour", F.col("player_id").alias(f"player_id_{side}"), F.lit(True).alias(f"_busy_{side}"))
        marked = marked.join(named, ["tour", f"player_id_{side}"], "left")
    either = F.coalesce("_busy_a", "_busy_b", F.lit(False))
    usual = _by_lists(marked.filter(~either), edges.join(busy, ["tour", "player_id"], "left_anti"), also)
    return usual.unionByName(_by_lookup(marked.filter(either), edges, also))


SUMMARY = ("common_opp_count", "delta_common_opp_win_pct", "delta_common_opp_matches")


def with_common_opponents(pairs: DataFrame, long: DataFrame, contest: Sequence[str] = ()) -> DataFrame:
    """Add the three summary columns to every pair row, zero where there is no common opponent.

    Pairs that have a contest of their own may name it by the columns of ``contest``, null with the tour only:
    the summaries then go to the contests, and wide rows that are dealt out by them stay where they are.
    """
    keys = ["tour", "player_id_a", "player_id_b", "tourney_date"]
    found = common_opponents(pairs.select(*keys, *contest), long, also=contest)
    if contest:
        keys = list(contest)
        found = found.select(*keys, *SUMMARY)
    return pairs.join(found, keys, "left").fillna(0.0, subset=list(SUMMARY))
