"""The tree search runs its whole grid; forests are the same however their runs are dealt out."""

from dataclasses import replace
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelframe.config import TreeConfig
from duelframe.operators import boosting as bo
from duelframe.operators import features as ft
from duelframe.operators import models as md
from duelframe.operators import newton
from duelframe.operators.newton import Fit, solve
from duelframe.plans import model_queries as mq


def test_search_runs_all_rounds_of_the_grid(monkeypatch):
    asked = {}
    monkeypatch.setattr(mq, "part", lambda *_: None)
    monkeypatch.setattr(mq.md, "tune", lambda train, grid, n_splits: asked.update(grid=grid, folds=n_splits) or (None, None))
    mq.gbt_tune(None, None)
    assert len(asked["grid"]) == 64 and asked["folds"] == 3
    assert {c.rounds for c in asked["grid"]} == {300, 600, 1000, 1500}
    assert len({replace(c, rounds=0) for c in asked["grid"]}) == 16


def table(spark, n=700):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(n, 7)), 2)
    x[:, 3], x[:, 4] = x[:, 2], x[:, 4] > 0  # a repeated input and one of two values
    y = (rng.random(n) < 1 / (1 + np.exp(-x[:, 0] * x[:, 1]))).astype(float)
    w, checked = rng.random(n), np.arange(n) % 4 == 0
    w[checked] = 0.0
    rows = [(r.tolist(), float(a), float(b), bool(c)) for r, a, b, c in zip(x, y, w, checked)]
    return x, spark.createDataFrame(rows, "x array<double>, y double, weight double, checked boolean").repartition(2).cache()


@pytest.mark.parametrize("config", [
    TreeConfig(rounds=9, depth=3, rate=0.3, leaf_hessian=1.0, patience=3), TreeConfig(rounds=18, depth=4, lasso=0.1, least_gain=0.05, patience=None),
])
def test_forests_do_not_depend_on_who_grows_them(spark, monkeypatch, config):
    x, rows = table(spark)
    runs = [bo.Run(0, config), bo.Run(1, replace(config, depth=2)), bo.Run(1, replace(config, ridge=5.0))]
    alone = bo.boost([rows, rows.filter("y < 2")], runs)
    for name, value in (("FLAT_ROWS", 0), ("SPARSE_SHARE", 10**9)):
        monkeypatch.setattr(bo, name, value)
    dense = bo.boost([rows, rows.filter("y < 2")], runs)
    monkeypatch.setattr(bo, "ALONE_CELLS", 0)
    together = bo.boost([rows, rows.filter("y < 2")], runs)
    for a, b, c in zip(alone, dense, together):
        assert len(a.trees) == len(b.trees) == len(c.trees) > 1
        assert a.margins(x) == pytest.approx(c.margins(x), abs=1e-12) and b.margins(x) == pytest.approx(c.margins(x), abs=1e-12)
        if config.patience:
            assert a.losses == pytest.approx(c.losses)


def test_chances_by_the_first_trees(spark):
    x, rows = table(spark)
    forest = bo.boost([rows], [bo.Run(0, TreeConfig(rounds=6, depth=2, leaf_hessian=1.0, patience=None))])[0]
    asked = [(forest, 6), (forest, 2), (forest, 0), (forest, 9)]
    for r in rows.select("x", bo.staged_probabilities(asked, F.col("x")).alias("p")).limit(40).collect():
        want = [float(1 / (1 + np.exp(-forest.first(n).margins(np.array([r.x])))[0])) for _, n in asked]
        assert r.p == pytest.approx(want)


def test_fewer_rounds_are_a_beginning_of_more(spark):
    grid = [TreeConfig(rounds=n, rate=r, depth=2, leaf_hessian=1.0, patience=None) for n in (1, 5) for r in (0.1, 0.3)]
    folds = []
    for _ in range(2):
        x, rows = table(spark, 300)
        folds.append(rows)
    forests = bo.boost(folds, [bo.Run(f, c) for f in range(2) for c in grid])
    assert [len(f.trees) for f in forests] == [1, 1, 5, 5] * 2
    assert forests[0].margins(x) == pytest.approx(forests[2].first(1).margins(x))
    assert md.tree_grid()[0].patience is None


def test_sets_may_differ_in_their_inputs(spark):
    """A fold whose training rows lack a category has an input less than the others."""
    x, rows = table(spark, 300)
    less = rows.select(F.slice("x", 1, 5).alias("x"), "y", "weight", "checked")
    fits = [Fit(0, 1.0), Fit(1, 1.0), Fit(1, 0.01, (2.0, 0.5))]
    found = solve([less, rows], fits)
    assert [len(s.coefficients) for s in found] == [5, 7, 7]
    assert all(np.abs(s.gradient).max() < 1e-8 for s in found)
    assert solve([rows], fits[:1])[0].coefficients == pytest.approx(found[1].coefficients, abs=1e-9)
    config = TreeConfig(rounds=3, depth=2, leaf_hessian=1.0, row_share=1.0, input_share=1.0, patience=None)
    both = bo.boost([less, rows], [bo.Run(0, config), bo.Run(1, config)])
    assert both[1].margins(x) == pytest.approx(bo.boost([rows], [bo.Run(0, config)])[0].margins(x))
    assert max(t.input.max() for t in both[0].trees) < 5


def test_blocks_are_small_values(spark, monkeypatch):
    """Readers hold many values of a written table at once, so a block must stay small however wide the rows are."""
    kept = {}
    monkeypatch.setattr(newton, "spool", lambda df, label: kept.setdefault(label, df.cache()))
    wide = spark.range(5000).select(F.array(*[F.rand(k) for k in range(100)]).alias("x"), (F.col("id") % 2).cast("double").alias("y"), F.lit(1.0).alias("weight"))
    solve([wide], [Fit(0)])
    sizes = kept["newton-blocks"].select(F.max(F.octet_length("x")), F.sum("rows")).first()
    assert sizes[0] <= newton.BLOCK_BYTES and sizes[1] == 5000


def test_scales_of_odd_columns(spark):
    """Nulls, constants, values far from zero, a column without values, and rows in several tasks."""
    rng = np.random.default_rng(4)
    far, near = 1e9 + rng.random(200), rng.normal(size=200)
    rows = [(float(f), None if i % 7 == 0 else float(v), 0.1, None) for i, (f, v) in enumerate(zip(far, near))]
    df = spark.createDataFrame(rows, "far double, near double, same double, none double").repartition(3)
    got = {r.feature: (r.mean, r.std) for r in ft.scale_statistics(df, df.columns).collect()}
    kept = near[np.arange(200) % 7 != 0]
    assert got["far"] == pytest.approx((far.mean(), far.std()), rel=1e-7) and got["near"] == pytest.approx((kept.mean(), kept.std()))
    assert got["same"] == (0.1, 1.0) and got["none"] == (None, None)
    plan = ft.scale_statistics(df, df.columns)._jdf.queryExecution().optimizedPlan().toString()
    assert "stddev" not in plan


def test_folds_are_not_copied(spark, monkeypatch):
    written = []
    real = md.spool
    monkeypatch.setattr(md, "spool", lambda df, label: written.append(label) or real(df, label))
    rnd = np.random.default_rng(6)
    base = spark.createDataFrame([(str(i), date(2020, 1, 1) + timedelta(days=i), int(rnd.random() < 0.5), "R_vs_R", "A") for i in range(60)],
                                 "match_id string, tourney_date date, label_player_a_win int, handedness_combo string, tourney_level string")
    rows = base.select("*", *[F.rand(k).alias(c) for k, c in enumerate(ft.NUMERIC)])
    _, scores = md.search(rows, md.logistic_grid((0.1, 1.0)), n_splits=2)
    assert scores.count() == 4 and written == ["folds", "fold-scores", "cv"]
