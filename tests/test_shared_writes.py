"""What model queries share is shuffled once, and not written where it is read once."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from duelframe.operators import features as ft
from duelframe.operators import opponents
from duelframe.plans import fixtures as fx
from duelframe.plans import stages


@pytest.fixture
def long(spark):
    """Both sides of contests; tours use the same ids, one tour is missing."""
    draw, rows = random.Random(3), []
    for i in range(300):
        one, two = (str(p) for p in draw.sample(range(12), 2))
        day = date(2020, 1, 1) + timedelta(draw.randrange(30))
        for tour in ("x", "y", None) if i % 3 else ("x",):
            rows += [(tour, f"m{i}", one, two, day, 1), (tour, f"m{i}", two, one, day, 0)]
    return spark.createDataFrame(rows, "tour string, match_id string, player_id string, opponent_id string, tourney_date date, label_win int")


def test_summaries_by_contest_are_those_by_sides(long):
    pairs = long.filter("player_id < opponent_id").select(
        "tour", "match_id", F.col("player_id").alias("player_id_a"), F.col("opponent_id").alias("player_id_b"), "tourney_date"
    )
    asked = pairs.withColumn("own", F.col("tour"))
    columns = [*pairs.columns, *opponents.SUMMARY]
    want = sorted(map(str, opponents.with_common_opponents(pairs, long).select(*columns).collect()))
    got = opponents.with_common_opponents(asked, long, ["own", "match_id"]).select(*columns)
    assert sorted(map(str, got.collect())) == want and len(want) == pairs.count()
    assert sum("common_opp_count=0.0" not in r for r in want) > 100
    for list_rows in (1, 20):  # lookups alone, and for the busy players
        one = opponents.common_opponents(asked.select(*asked.columns), long, list_rows, ["own", "match_id"]).drop("own", "match_id").distinct()
        assert sorted(map(str, one.collect())) == sorted(map(str, opponents.common_opponents(pairs, long).collect()))


def test_wide_rows_stay_where_they_were_paired(spark, sf):
    """The join with the common opponents moves the summaries only."""
    plan = stages.wide(stages.player_track(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join LeftOuter" in line)
    assert "_dealt_by" in join and "match_id" in join and "player_id_a" not in join


def test_copies_that_one_step_reads_are_not_written(spark, sf, monkeypatch):
    from duelframe.plans import model_queries as mq

    monkeypatch.setattr(fx, "_stages", {})
    mq.rows(spark, sf).count()
    made = {name for _, _, name in fx._stages}
    assert "baseline_track" in made and not made & {"model_rows", "player_track"}
    stages.player_track(spark, sf)  # a stage that others read is written, and then read by all
    again = fx.stage_or_plan(spark, sf, "player_track", lambda: pytest.fail("written already"))
    assert again.columns == stages.player_track(spark, sf).columns


def test_medians_read_the_rows_themselves(spark, monkeypatch):
    df = spark.createDataFrame([(1.0,), (4.0,), (None,), (2.0,)], "a double")
    monkeypatch.setattr("duelframe.session.spool", lambda *_: pytest.fail("a copy"))
    monkeypatch.setattr(ft, "spool", lambda *_: pytest.fail("a copy"), raising=False)
    assert ft.exact_medians(df, ["a"]).first()["median"] == 2.0


def test_bins_lie_input_by_input(spark):
    """A pass counts an input at a time, so its bins are next to each other."""
    import numpy as np

    from duelframe.operators import boosting as bo

    x = np.arange(12.0).reshape(4, 3)
    rows = spark.createDataFrame([(r.tolist(), 1.0, 1.0, False) for r in x], "x array<double>, y double, weight double, checked boolean").coalesce(1)
    cuts = [np.array([1.0, 5.0]), np.array([2.0]), np.array([3.0, 6.0, 9.0])]
    block = bo.binned_blocks(rows, 0, cuts, 1, 0.0).first()
    bins = np.frombuffer(block["bins"], np.uint8)
    for k, cut in enumerate(cuts):
        assert bins[4 * k : 4 * k + 4].tolist() == np.searchsorted(cut, x[:, k], "right").tolist()
    assert bo._matrix(block["bins"], 4, 3).T.ravel().tolist() == bins.tolist()
