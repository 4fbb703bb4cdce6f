import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from duelframe.operators import history as hs
from duelframe.operators.ordering import global_index, running_total
from duelframe.operators.prior import Prior, heavy_keys, prior_features
from duelframe.operators.snapshots import point_states, prior_service_counts
from duelframe.plans import fixtures as fx
from duelframe.plans import stages


def sides(spark, rows):
    """(match_num, day, player, opponent, surface, round, won, service pct)"""
    data = [(f"e__{n}", "t", "e", float(n), d, p, o, "R", s, r, w, v) for n, d, p, o, s, r, w, v in rows]
    base = spark.createDataFrame(
        data,
        "match_id string, tour string, tourney_id string, match_num double, tourney_date date, player_id string, opponent_id string, "
        "opponent_hand string, surface string, round string, label_win int, service_points_won_pct double",
    )
    rest = {s for s in [*hs.LAST10.values(), *hs.SURFACE10.values()]} - set(base.columns)
    return base.select("*", F.col("service_points_won_pct").alias("return_points_won_pct"), *[F.lit(0.5).alias(c) for c in rest if c != "return_points_won_pct"])


def test_path_through_one_event(spark):
    numbers = [5, 68, 99, 114, 121, 125, 127]
    day = date(2024, 1, 15)
    got = hs.player_history(sides(spark, [(n, day, "1", str(n), "Hard", "F", 1, 0.5) for n in numbers])).orderBy("match_num").collect()
    assert [r.matches_played for r in got] == list(range(7))
    assert [r.current_win_streak for r in got] == list(range(7))
    assert got[0].previous_match_win is None and got[1].previous_match_win == 1
    assert [r.has_surface_history for r in got] == [0, 0, 0, 0, 0, 1, 1]
    assert [r.matches_last_30_days for r in got] == [0] * 7  # the own day never counts


def test_thirty_row_history(spark):
    rows = [(i, date(2024, 1, 1) + timedelta(days=i), "1", "2", "Hard", "F", 1, 0.5 + 0.01 * i) for i in range(11)]
    got = hs.player_history(sides(spark, rows)).orderBy("match_num").collect()
    assert [r.service_points_won_pct_30 for r in got[:10]] == [None] * 10
    assert got[10].service_points_won_pct_30 == pytest.approx(sum(0.5 + 0.01 * i for i in range(10)) / 10)
    assert [r.has_serve_history for r in got] == [0] * 10 + [1]


def _table(df, names):
    return {(r.match_id, r.player_id): [r[n] for n in names] for r in df.collect()}


def test_heavy_players_take_chunks_and_agree(spark, sf):
    long = stages.sides(spark, sf)
    usual = hs.player_history(long, heavy_rows=10**9)
    names = [c for c in usual.columns if c not in long.columns]
    want = _table(usual, names)
    for limit, chunk in ((0, 40), (55, 31)):  # all players heavy; some heavy
        got = _table(hs.player_history(long, heavy_rows=limit, chunk_rows=chunk), names)
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == pytest.approx(want[k], nan_ok=True), (k, names)


def test_heavy_matches_in_service_counts(spark, sf):
    states = point_states(fx.points(spark, sf))
    order = ["match_id", "point_index"]
    want = prior_service_counts(states).orderBy(*order).collect()
    assert prior_service_counts(states, heavy_rows=10, chunk_rows=7).orderBy(*order).collect() == want


def test_null_groups_in_chunks(spark):
    df = spark.createDataFrame([(1, None, i, i % 3) for i in range(50)] + [(1, "x", i, 1) for i in range(50)], "p int, s string, o int, v int")
    measures = [Prior("n", "count", None, "all"), Prior("m", "mean", "v", "rows", 5), Prior("t", "sum", "v", "all", own=True)]
    want = sorted(map(str, prior_features(df, ["p", "s"], ["o"], measures).collect()))
    heavy = heavy_keys(df, ["p"], 10)
    assert sorted(map(str, prior_features(df, ["p", "s"], ["o"], measures, heavy=heavy, chunk_rows=8).collect())) == want


def test_later_rows_never_change_earlier_features(spark):
    rnd = random.Random(3)
    rows = [
        (i, date(2024, 1, 1) + timedelta(days=rnd.randrange(60)), rnd.choice("ab"), rnd.choice("xyz"), rnd.choice(["Hard", "Clay"]), "F", rnd.randrange(2), rnd.random())
        for i in range(60)
    ]
    rows.sort(key=lambda r: (r[1], r[0]))
    changed = rows[:40] + [(*r[:6], 1 - r[6], 9.0) for r in rows[40:]]
    names = ["win_rate_last10", "current_win_streak", "win_pct_last_365_days", "h2h_wins", "surface_win_pct_last10", "service_points_won_pct_30"]
    one, two = (_table(hs.player_history(sides(spark, r)), names) for r in (rows, changed))
    for r in rows[:40]:
        assert one[f"e__{r[0]}", r[2]] == two[f"e__{r[0]}", r[2]]


def test_global_index_and_running_total(spark):
    rnd = random.Random(5)
    data = [("hot" if rnd.random() < 0.7 else rnd.choice(["a", None]), i, rnd.randrange(10)) for i in range(500)]
    df = spark.createDataFrame(data, "g string, o int, v int")
    placed = {r.o: r.ix for r in global_index(df, ["o"], "ix", ["g"]).collect()}
    sums = {r.o: r.t for r in running_total(df, ["o"], {"t": "v"}, ["g"]).collect()}
    for g, o, _ in data:
        before = [x for x in data if x[0] == g and x[1] < o]
        assert placed[o] == len(before) and sums[o] == sum(x[2] for x in before)
