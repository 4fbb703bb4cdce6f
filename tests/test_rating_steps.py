"""The steps of a rating are worked out once per contest."""

from datetime import date

import pytest

from duelframe.config import RatingConfig
from duelframe.functions.scores import margin_multiplier, sets_won
from duelframe.operators import ratings

CONTESTS = "tour string, tourney_id string, tourney_date date, match_num long, surface string, score string, tourney_level string, winner_id string, winner_name string, loser_id string, loser_name string, w_ace double, l_ace double"


@pytest.fixture
def contests(spark):
    day = date(2020, 1, 6)
    rows = [
        ("X", "T1", day, 1, "Hard", "6-4 6-4", "G", "1", "a", "2", "b", 3.0, 1.0),
        ("X", "T1", day, 2, "Clay", "6-7(4) 6-3 6-1", "A", "2", "b", "1", "a", float("nan"), None),
        ("X", "T1", None, None, None, None, None, "1", "a", None, None, 2.0, float("inf")),
    ]
    return spark.createDataFrame(rows, CONTESTS)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scores_are_parsed_once(spark):
    scores = spark.createDataFrame([("6-4 6-4 6-4",), ("6-7(4) 6-3 6-1",), ("6-4 RET",), ("",), ("x",), (None,)], "score string")
    factor = scores.select("score", margin_multiplier("score", RatingConfig()).alias("f"), sets_won("score").alias("s"))
    assert [(r.f, *r.s) for r in factor.collect()] == [(1.3, 3, 0), (1.0, 2, 1), (1.0, 1, 0), (1.0, 1, 0), (1.0, 1, 0), (1.0, 1, 0)]
    assert plan(scores.select(margin_multiplier("score", RatingConfig()).alias("f"))).count("split(") == 1


def test_ratings_work_the_steps_out_once(contests, monkeypatch):
    """The order is sampled and shuffled from written columns, so the scores are not read a second and third time."""
    seen = []
    whole = ratings.global_index
    monkeypatch.setattr(ratings, "global_index", lambda df, *rest, **named: seen.append(df) or whole(df, *rest, **named))
    rated = ratings.rate_contests(contests)
    assert rated.count() == 3 and rated.columns[: len(contests.columns)] == contests.columns
    assert not any(c.startswith("_") for c in rated.columns)
    assert "split(" not in plan(seen[0]) and "Contains" not in plan(seen[0])
