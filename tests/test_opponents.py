import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from duelframe.operators import opponents


def meetings_of_few(spark):
    """Both sides of contests of few players, one of them very busy, with missing tours, rivals, days and labels."""
    draw, rows = random.Random(5), []
    for i in range(400):
        one, two = (str(p) for p in draw.sample(range(15), 2))
        tour, day = (None if i % 50 == 0 else draw.choice("xy")), date(2020, 1, 1) + timedelta(draw.randrange(40))
        one, two = ("0" if i % 4 == 0 else one), (None if i % 61 == 0 else two)
        won = None if i % 5 == 0 else 1
        day = None if i % 37 == 0 else day
        rows += [(tour, one, two, day, won), (tour, two, one, day, None if won is None else 0)]
    long = spark.createDataFrame(rows, "tour string, player_id string, opponent_id string, tourney_date date, label_win int")
    return long, long.select("tour", F.col("player_id").alias("player_id_a"), F.col("opponent_id").alias("player_id_b"), "tourney_date"), rows


def brute(rows):
    out = {}
    for tour, a, b, day, _ in rows:
        if None in (tour, a, b, day):
            continue
        seen = {}
        for side, player in (("a", a), ("b", b)):
            for t, p, o, d, w in rows:
                if t == tour and p == player and o is not None and d is not None and d < day:
                    seen.setdefault(o, {}).setdefault(side, []).append(w)
        common = [s for s in seen.values() if len(s) == 2]
        if common:
            out[tour, a, b, day] = (float(len(common)), float(sum(len(s["a"]) - len(s["b"]) for s in common)))
    return out


def test_lists_and_lookups_agree(spark, monkeypatch):
    long, pairs, rows = meetings_of_few(spark)

    def found(list_rows):
        got = opponents.common_opponents(pairs, long, list_rows).collect()
        assert len({r[:4] for r in got}) == len(got)
        return {tuple(r[:4]): tuple(r[4:]) for r in got}

    lists = found(10_000)
    assert {k: (v[0], v[2]) for k, v in lists.items()} == brute(rows)
    hashed = F.hash
    for list_rows in (1, 60):  # lookups alone, and for the busy player
        assert found(list_rows) == lists
    monkeypatch.setattr(opponents.F, "hash", lambda c: hashed(c) % 2)  # different opponents of one hash
    assert found(10_000) == lists


def test_no_row_stands_for_a_candidate(spark):
    long, pairs, _ = meetings_of_few(spark)
    plan = opponents.common_opponents(pairs, long)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 3 and plan.count("Generate explode(days") == 1
    assert "opponent_id" not in "".join(line for line in plan.splitlines() if "Join Inner" in line)
