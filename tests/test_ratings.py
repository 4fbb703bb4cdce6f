import pytest
from pyspark.sql import functions as F

from duelframe.config import RatingConfig
from duelframe.functions.scores import sets_won
from duelframe.operators.ratings import rate_contests
from duelframe.plans import fixtures as fx

COLUMNS = "tourney_date string, match_num long, winner_id string, loser_id string, surface string, score string"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).select(
        "*", F.col("tourney_date").cast("date").alias("d"), F.lit("t").alias("tour"), F.lit("e").alias("tourney_id"),
        F.lit("A").alias("tourney_level"), F.col("winner_id").alias("winner_name"), F.col("loser_id").alias("loser_name"),
    ).drop("tourney_date").withColumnRenamed("d", "tourney_date")


def test_three_contests(spark):
    rows = [("2024-01-01", 1, "1", "2", "Hard", None), ("2024-01-02", 2, "1", "3", "Hard", None), ("2024-01-03", 3, "2", "1", "Hard", None)]
    got = {r.match_num: r for r in rate_contests(frame(spark, rows)).collect()}
    assert [got[i].winner_elo_pre for i in (1, 2, 3)] == pytest.approx([1500.0, 1512.0, 1488.0])
    assert [got[i].loser_elo_pre for i in (1, 2, 3)] == pytest.approx([1500.0, 1500.0, 1523.585699], abs=1e-6)


def test_new_surface_starts_from_overall(spark):
    rows = [("2024-01-01", 1, "1", "2", "Hard", None), ("2024-01-02", 2, "1", "3", "clay", None)]
    got = {r.match_num: r for r in rate_contests(frame(spark, rows)).collect()}
    assert got[2].winner_surface_elo_pre == pytest.approx(0.7 * 1512.0 + 0.3 * 1500.0)
    assert got[2].surface_normalized == "Clay"


def test_void_contest_changes_nothing(spark):
    rows = [("2024-01-01", 1, "1", "2", "Hard", "6-4 RET"), ("2024-01-02", 2, "1", "2", "Hard", "6-4 6-4")]
    got = {r.match_num: r for r in rate_contests(frame(spark, rows)).collect()}
    assert got[1].winner_elo_post == got[2].winner_elo_pre == 1500.0
    assert got[2].winner_elo_post == pytest.approx(1500.0 + 24.0 * 1.2 * 0.5)


def test_sets_won(spark):
    cases = {
        "6-4 7-6(5)": (2, 0), "6-7(4) 6-3 6-1": (2, 1), "6(3)-7 6-4": (2, 0), "": (1, 0), "W/O": (1, 0),
        "4-6 6-4 [10-8]": (1, 1), "nonsense": (1, 0), "6-4 6-4 6-4": (3, 0),
    }
    df = spark.createDataFrame([(s,) for s in cases], "score string").select("score", sets_won("score").alias("s"))
    got = {r.score: (r.s.winner, r.s.loser) for r in df.collect()}
    # the bracketed decider reads as 10-8 to the first player
    cases["4-6 6-4 [10-8]"] = (2, 1)
    assert got == cases


def test_turns_give_the_same_ratings(spark, sf):
    """Cutting the pools into short turns must not change a single rating."""
    contests = fx.contests(spark, sf)
    names = ["winner_elo_pre", "loser_elo_post", "winner_surface_elo_pre", "loser_surface_elo_post"]
    whole = {r.match_num: r for r in rate_contests(contests).select("match_num", *names).collect()}
    cut = {r.match_num: r for r in rate_contests(contests, RatingConfig(turn_rows=100)).select("match_num", *names).collect()}
    assert whole.keys() == cut.keys() and len(whole) > 1000
    for k, r in whole.items():
        assert [cut[k][n] for n in names] == pytest.approx([r[n] for n in names], abs=1e-9)


def test_equal_gain_and_loss(spark, sf):
    moved = F.col("winner_elo_post") - F.col("winner_elo_pre") + F.col("loser_elo_post") - F.col("loser_elo_pre")
    assert rate_contests(fx.contests(spark, sf)).agg(F.max(F.abs(moved))).first()[0] < 1e-9


def test_shared_ids_and_missing_numbers(spark):
    """Tours may share ids, rows may repeat, and a missing number is rated last."""
    from duelframe.operators.longview import long_view
    from duelframe.operators.pairing import pair_wide

    rows = [("2024-01-01", None, "1", "2", "Hard", None), ("2024-01-01", 5, "1", "3", "Hard", None)]
    one = frame(spark, rows)
    two = one.withColumn("tour", F.lit("u"))
    rated = rate_contests(one.union(two)).collect()
    assert len(rated) == 4
    assert all(r.winner_elo_pre == (1512.0 if r.match_num is None else 1500.0) for r in rated)
    again = rate_contests(one.union(one)).collect()
    assert len(again) == 4 and len({r.winner_elo_pre for r in again}) == 4

    wide = pair_wide(long_view(rate_contests(one.union(two))))
    assert sorted((r.tour, r.match_id) for r in wide.collect()) == [("t", "e__"), ("t", "e__5"), ("u", "e__"), ("u", "e__5")]
    with pytest.raises(Exception, match="without exactly two sides"):
        pair_wide(long_view(rate_contests(one.union(one)))).collect()
    assert pair_wide(long_view(rate_contests(one.union(one))), unpaired="drop").count() == 0
