import random

import brute
import pytest
from pyspark.sql import functions as F

from duelframe.functions import probability as pr
from duelframe.functions.points import label_count
from duelframe.operators.inplay import score_states
from duelframe.operators.metrics import auc, checkpoint_metrics
from duelframe.operators.scoring import scoring_features, with_prematch
from duelframe.operators.snapshots import build_snapshots, score_snapshots
from duelframe.plans import scoring_queries as sq
from duelframe.session import spool

STATE = "id int, sets_a int, sets_b int, games_a int, games_b int, points_a string, points_b string, server string, p_a double, p_b double, best_of int"


def test_hold(spark):
    df = spark.createDataFrame([(0.5,), (0.6,), (0.7,), (None,)], "p double").select(pr.hold(F.col("p")).alias("h"))
    assert [r.h for r in df.collect()] == pytest.approx([0.5, 0.7357, 0.9008, 0.5], abs=1e-4)


def test_closed_forms_match_recursion(spark):
    grid = [(a / 10, b / 10, bo) for a in range(0, 11, 2) for b in range(1, 10, 2) for bo in (3, 5)]
    df = spark.createDataFrame(grid, "a double, b double, n int")
    out = with_prematch(df, F.col("a"), F.col("b"), F.col("n"), "m").withColumn("t", pr.tiebreak(F.col("a"), F.col("b"), False))
    clip = lambda x: min(max(x, 0.01), 0.99)
    for r in out.collect():
        assert r.m == pytest.approx(brute.prematch(r.a, r.b, r.n), abs=1e-12)
        assert r.t == pytest.approx(brute.tiebreak(0, 0, "B", clip(r.a), clip(r.b)), abs=1e-12)


def _states(n, seed=1):
    rnd, rows = random.Random(seed), []
    while len(rows) < n:
        bo = rnd.choice([3, 5])
        sa, sb, ga, gb = (rnd.randrange(k) for k in (bo // 2 + 1, bo // 2 + 1, 7, 7))
        if max(ga, gb) >= 6 and abs(ga - gb) >= 2:
            continue
        if ga == gb == 6:
            a, b = rnd.randrange(12), rnd.randrange(12)
            if max(a, b) >= 7 and abs(a - b) >= 2:
                continue
            pa, pb = str(a), str(b)
        else:
            pa, pb = rnd.choice(list(brute.LABELS)), rnd.choice(list(brute.LABELS))
            if "AD" in (pa, pb) and {pa, pb} != {"40", "AD"}:
                continue
        rows.append((len(rows), sa, sb, ga, gb, pa, pb, rnd.choice("AB"), rnd.uniform(0.3, 0.8), rnd.uniform(0.3, 0.8), bo))
    return rows


def test_live_states_match_recursion(spark):
    rows = _states(800)
    got = {r.id: r.prob_a for r in score_states(spark.createDataFrame(rows, STATE)).collect()}
    for r in rows:
        assert got[r[0]] == pytest.approx(brute.match(*r[1:]), abs=1e-10), r


def test_live_state_examples(spark):
    rows = [
        (0, 2, 0, 0, 0, "0", "0", "A", 0.6, 0.6, 3), (1, 0, 2, 0, 0, "0", "0", "A", 0.6, 0.6, 3),
        (2, 0, 0, 0, 0, "0", "0", "A", 0.5, 0.5, 3), (3, 0, 0, 6, 6, "9", "8", "B", 0.6, 0.6, 3),
        (4, 0, 0, 8, 6, "0", "0", "A", 0.6, 0.6, 3), (5, 0, 0, 0, 0, "x", "0", "A", 0.6, 0.6, 3),
    ]
    got = {r.id: (r.prob_a, r.prob_a_problem) for r in score_states(spark.createDataFrame(rows, STATE)).collect()}
    assert [got[i][0] for i in (0, 1, 2)] == pytest.approx([1.0, 0.0, 0.5])
    assert 0.5 < got[3][0] < 1.0
    assert got[4] == (None, "set already over") and got[5] == (None, "unreadable points")


def test_shrinking(spark):
    df = spark.range(1).select(
        pr.shrink(F.lit(0.6), F.lit(7), F.lit(10), 40.0).alias("a"), pr.shrink(F.lit(0.6), F.lit(0), F.lit(0), 0.0).alias("b"),
        pr.shrink(F.lit(0.6), F.lit(3), F.lit(2)).alias("c"),
    ).first()
    assert df.a == pytest.approx((40 * 0.6 + 7) / 50) and df.b == pytest.approx(0.6) and df.c is None


def test_point_labels(spark):
    cases = {"0": 0, "love": 0, "15": 1, " 30 ": 2, "40": 3, "AD": 4, "advantage": 4, "11": 11, "?": None, "": 0}
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", label_count(F.col("v")).alias("n"))
    assert {r.v: r.n for r in df.collect()} == cases


def test_wide_features(spark):
    names = [f"{k}_points_won_pct_30_{s}" for k in ("service", "return") for s in "ab"] + [f"has_{k}_history_{s}" for k in ("serve", "return") for s in "ab"]
    rows = [(3.0, 0.68, 0.6, 0.42, 0.35, 1, 1, 1, 1), (5.0, None, 0.6, None, 0.35, 0, 1, 0, 1)]
    schema = "best_of double, " + ", ".join(f"{n} double" for n in names[:4]) + ", " + ", ".join(f"{n} int" for n in names[4:])
    one, two = scoring_features(spark.createDataFrame(rows, schema)).orderBy("best_of").collect()
    assert one.markov_match_win_prob_a > 0.5 and (one.has_serve_history, one.has_return_history) == (1, 1)
    assert one.markov_match_win_prob_a == pytest.approx(brute.prematch((0.68 + 0.65) / 2, (0.6 + 0.58) / 2, 3), abs=1e-12)
    assert two.has_serve_history == 0
    for r in (one, two):
        assert r.markov_match_win_prob_b == pytest.approx(1 - r.markov_match_win_prob_a)
        assert r.delta_markov_match_win == pytest.approx(r.markov_match_win_prob_a - r.markov_match_win_prob_b)


def _points(spark, rows):
    return spark.createDataFrame(
        [("m", i + 1, *r) for i, r in enumerate(rows)],
        "match_id string, Pt int, Set1 int, Set2 int, Gm1 int, Gm2 int, Pts string, Svr int, PtWinner int",
    )


def _meta(spark, times=1):
    return spark.createDataFrame(
        [("m", "P", "Q", "20240115.0", "Open", "F", "hard", "3", "S")] * times,
        "match_id string, `Player 1` string, `Player 2` string, `Date` string, Tournament string, Round string, Surface string, `Best of` string, `Final TB?` string",
    )


def test_shifted_counts_and_label(spark):
    rows = [(1, 0, 5, 0, "0-0", 1, 1), (1, 0, 5, 0, "15-0", 1, 2), (1, 0, 5, 0, "15-15", 1, 1), (1, 0, 5, 0, "40-15", 1, 1)]
    got = build_snapshots(_points(spark, rows), _meta(spark, 2), "atp").orderBy("point_index").collect()
    assert [r.p1_service_points_played_before for r in got] == [0, 1, 2, 3]
    assert [r.p1_service_points_won_before for r in got] == [0, 1, 1, 2]
    assert {r.match_winner_player for r in got} == {1} and {r.label_player1_win_match for r in got} == {1}
    assert got[0].surface == "Hard" and str(got[0].match_date) == "2024-01-15"  # doubled metadata does not fan out


def test_flip_when_second_player_serves(spark):
    got = build_snapshots(_points(spark, [(0, 0, 0, 0, "40-AD", 2, 1)]), _meta(spark), "atp").first()
    assert (got.points_1, got.points_2, got.server) == ("AD", "40", "B")
    assert got.match_winner_player is None and got.label_player1_win_match is None


def test_snapshots_match_recursion(spark, sf):
    """Every snapshot of the small tables against the score-by-score recursion."""
    snaps = score_snapshots(sq.snapshots(spark, sf)).collect()
    for r in snaps:
        p = [(24 + r[f"p{n}_service_points_won_before"]) / (48 + r[f"p{n}_service_points_played_before"]) for n in (1, 2)]
        want = brute.match(r.sets_1, r.sets_2, r.games_1, r.games_2, r.points_1, r.points_2, r.server, *p, r.best_of)
        assert r.prob_player1_win_match == pytest.approx(want, abs=1e-10)


def test_checkpoint_metrics(spark):
    scored = spool(score_snapshots(sq.checkpoint_rows(spark, "/root/testdata/sf0.01")), "scored")
    got = {(r.group, r.value): r for r in checkpoint_metrics(scored).collect()}
    rows = scored.collect()
    assert got
    for (group, value), r in got.items():
        split, _, kind = group.partition(":")
        mine = [
            x for x in rows
            if (not kind and x.split == value) or (x.split == split and kind == "checkpoint_type" and x.checkpoint_type == value)
            or (x.split == split and kind == "tour_surface" and f"{x.tour}/{x.surface}" == value)
        ]
        assert r.rows == len(mine) and r.matches == len({x.match_id for x in mine})
        pos = [x.prob_player1_win_match for x in mine if x.label_player1_win_match == 1]
        neg = [x.prob_player1_win_match for x in mine if x.label_player1_win_match == 0]
        want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None
        assert r.roc_auc == (pytest.approx(want) if want is not None else None)


def test_auc_by_pairs(spark):
    rnd = random.Random(2)
    rows = [("g", int(rnd.random() < 0.4), rnd.randrange(8) / 8) for _ in range(300)] + [("one", 1, 0.3)]
    got = {r.g: r.roc_auc for r in auc(spark.createDataFrame(rows, "g string, y int, p double"), ["g"], "y", "p").collect()}
    pos, neg = [p for g, y, p in rows if g == "g" and y], [p for g, y, p in rows if g == "g" and not y]
    assert got["g"] == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)))
    assert got["one"] is None
