"""Branches are trained by all four entry points."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelframe.config import LogisticConfig, SplitConfig, TreeConfig
from duelframe.operators import features as ft
from duelframe.operators import models as md
from duelframe.plans import model_queries as mq

SPLIT = SplitConfig.until("2020-06-30", "2020-09-30")


@pytest.fixture(scope="module")
def wide(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(360):
        x = rnd.gauss(0, 1)
        rows.append((str(i), rnd.choice("EW"), date(2020, 1, 1) + timedelta(days=i), x, int(rnd.random() < 1 / (1 + np.exp(-2 * x))), rnd.choice(["R_vs_R", "L_vs_R"])))
    base = spark.createDataFrame(rows, "match_id string, tour string, tourney_date date, delta_elo double, label_player_a_win int, handedness_combo string")
    rest = [F.lit(0.0).alias(c) for c in ft.NUMERIC if c not in ("delta_elo",)]
    return base.select("*", *rest, F.lit("A").alias("tourney_level"), F.lit("HARD").alias("surface"), F.lit("F").alias("round")).cache()


def test_entry_points_are_whole():
    entries = md.entry_points()
    assert list(entries) == ["logit", "logit_tuned", "trees", "trees_tuned"]
    assert len(entries["logit_tuned"]["grid"]) == 14 and len(entries["trees_tuned"]["grid"]) == 64


def test_query_trains_every_entry_point_of_every_branch(monkeypatch, spark):
    seen = []

    def trained(rows, split, surface=None, **options):
        seen.append((surface, options.get("model", "logit"), len(options.get("grid", ()))))
        return {"metrics": spark.createDataFrame([("test", 1)], "split string, rows int"), "calibration": None}

    monkeypatch.setattr(mq.stages, "baseline_track", lambda *_: spark.createDataFrame([("E",), ("W",)], "tour string"))
    monkeypatch.setattr(md, "train_branch", trained)
    got = {(r.tour, r.surface, r.model) for r in mq.branches(spark, "").collect()}
    assert got == {(t, s, m) for t in "EW" for s in ("Hard", "Clay", "Grass") for m in md.entry_points()}
    assert set(seen) == {(s, m, n) for s in ("Hard", "Clay", "Grass") for m, n in (("logit", 0), ("logit", 14), ("trees", 0), ("trees", 64))}


def test_branches_by_small_grids(spark, wide):
    small = TreeConfig(rounds=4, depth=2, rate=0.3, leaf_hessian=1.0, patience=None)
    entries = {"line": {}, "lines": {"grid": [LogisticConfig(C=c) for c in (0.1, 1.0)]}, "trees": {"model": "trees", "trees": small},
               "tuned": {"model": "trees", "grid": [small]}}
    got = md.train_branches(wide, SPLIT, [{"tour": "E", "surface": "Hard"}], entries).collect()
    assert {(r.tour, r.surface, r.model, r.split) for r in got} == {("E", "Hard", m, s) for m in entries for s in ("validation", "test")}
    assert all((r.calibration is not None) == (r.model in ("trees", "tuned")) for r in got)
    assert all(r.roc_auc > 0.6 for r in got if r.split == "test")


def test_tuned_trees_keep_their_patience(spark, wide):
    rows = ft.training_rows(wide, "Hard")
    best = md.tuned_config(rows, [TreeConfig(rounds=2, depth=2, leaf_hessian=1.0, patience=None)], n_splits=2)
    assert best.patience == TreeConfig().patience and best.rounds == 2
