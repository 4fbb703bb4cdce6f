from duelframe.operators import history as hs
from duelframe.plans import stages


def test_history_shares_sorts_and_reads_no_box_scores(spark, sf):
    track = stages.player_track(spark, sf)
    assert not {"serve_points", "opponent_name", "tourney_name", "minutes"} & set(track.columns)
    long = track.select(*hs.INPUTS)
    plan = hs.player_history(long)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") <= 5
