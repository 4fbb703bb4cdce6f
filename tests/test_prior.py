"""The plan for heavy groups gives what the plain windows give, for every aggregate, frame and missing key."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from duelframe.operators.ordering import global_index
from duelframe.operators.prior import AGGREGATES, FRAMES, Prior, heavy_keys, prior_features


def rows(seed):
    rng = random.Random(seed)
    first = date(2024, 1, 1)
    return [
        (rng.choice(["hot", "hot", "a", None]), rng.choice(["x", None]),
         None if rng.random() < 0.1 else first + timedelta(days=rng.randrange(12)), None if rng.random() < 0.1 else rng.randrange(6), k,
         None if rng.random() < 0.3 else rng.randrange(50))
        for k in range(240)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_both_plans_agree(spark, seed):
    df = spark.createDataFrame(rows(seed), "p string, s string, d date, n int, k int, v int")
    measures = [
        Prior(f"{agg}_{frame}_{size}_{own}", agg, "v", frame, size, least, own=own)
        for agg in AGGREGATES for frame in FRAMES for size, least in ((4, 1), (7, 3)) for own in ((False, True) if frame != "days" else (False,))
    ] + [Prior(f"rows_{frame}", "count", None, frame, 5) for frame in FRAMES]
    order = ["d", "n", "k"]
    want = {r.k: r for r in prior_features(df, ["p", "s"], order, measures, day="d").collect()}
    heavy = heavy_keys(df, ["p"], 30)
    assert heavy.where("p IS NULL").count() == 1
    got = {r.k: r for r in prior_features(df, ["p", "s"], order, measures, day="d", heavy=heavy, chunk_rows=9).collect()}
    assert got == want


def test_days_against_brute_force(spark):
    data = rows(3)
    df = spark.createDataFrame(data, "p string, s string, d date, n int, k int, v int")
    measures = [Prior("top", "max", "v", "days", 3), Prior("newest", "last", "v", "days", 3), Prior("seen", "count", "v", "days", 3)]
    got = {r.k: r for r in prior_features(df, ["p"], ["d", "n", "k"], measures, day="d").collect()}
    for p, _, d, _, k, _ in data:
        past = sorted((x for x in data if d and x[2] and x[0] == p and x[5] is not None and 1 <= (d - x[2]).days <= 3),
                      key=lambda x: (x[2], x[3] is None, x[3], x[4]))
        assert got[k].top == max((x[5] for x in past), default=None)
        assert got[k].newest == (past[-1][5] if past else None)
        assert got[k].seen == (len(past) if d else None)


def test_missing_values_come_last(spark):
    df = spark.createDataFrame([("a", 2, 1), ("a", None, 2), ("a", 1, 3), (None, 1, 4)], "g string, o int, v int")
    assert {r.v: r.ix for r in global_index(df, ["o", "v"], "ix", ["g"]).collect()} == {3: 0, 1: 1, 2: 2, 4: 0}
    got = prior_features(df, ["g"], ["o"], [Prior("before", "last", "v", "rows", 1)]).where("o IS NULL").first()
    assert got.before == 1


def test_unknown_measures_are_refused():
    for bad in (("x", "median"), ("x", "sum", "v", "weeks")):
        with pytest.raises(ValueError):
            Prior(*bad)
    with pytest.raises(ValueError):
        Prior("x", "sum", "v", "days", 3, own=True)
    assert F is not None
