import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from duelframe.config import LogisticConfig, SplitConfig, TreeConfig
from duelframe.operators import features as ft
from duelframe.operators import models as md
from duelframe.operators import splits as sp

SPLIT = SplitConfig.until("2020-06-30", "2020-09-30")


@pytest.fixture(scope="module")
def wide(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(400):
        x = rnd.gauss(0, 1)
        rows.append((str(i), date(2020, 1, 1) + timedelta(days=i % 366), x if i % 9 else None, int(rnd.random() < 1 / (1 + np.exp(-2 * x))),
                     rnd.choice(["R_vs_R", "L_vs_R"])))
    base = spark.createDataFrame(rows, "match_id string, tourney_date date, delta_elo double, label_player_a_win int, handedness_combo string")
    rest = [F.lit(0.0).alias(c) for c in ft.NUMERIC if c not in ("delta_elo",)]
    return base.select("*", *rest, F.lit("A").alias("tourney_level"), F.lit("HARD").alias("surface"), F.lit("F").alias("round")).cache()


def test_feature_lists():
    assert len(ft.numeric_features()) == 51 and len(ft.numeric_features(True)) == 49
    assert len(set(ft.NUMERIC)) == 51


def test_exact_medians_and_modes(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, 1.0, 2.0, 5.5]), rnd.random(), rnd.choice("aabb")) for _ in range(301)]
    df = spark.createDataFrame(rows, "a double, b double, c string")
    got = {r.feature: r.median for r in ft.exact_medians(df, ["a", "b"]).collect()}
    assert got["a"] == np.median([r[0] for r in rows if r[0] is not None]) and got["b"] == pytest.approx(np.median([r[1] for r in rows]))
    tie = spark.createDataFrame([("b",), ("a",), ("b",), ("a",)], "c string")
    assert ft.modes(tie, ["c"]).first().mode == "a"


def test_medians_by_digits(spark):
    """Signs, infinities, equal values, missing ones and columns without any."""
    rnd = random.Random(7)
    draw = {
        "wide": lambda: rnd.choice([-1, 1]) * 10 ** rnd.uniform(-300, 300), "near": lambda: 1.0 + rnd.random() * 1e-12,
        "signs": lambda: rnd.choice([-0.0, 0.0, -2.5, 2.5, None]), "none": lambda: None, "ends": lambda: rnd.choice([float("-inf"), 1.0, float("inf")]),
    }
    for size in (1, 2, 37, 200):
        rows = [tuple(f() for f in draw.values()) for _ in range(size)]
        got = {r.feature: r.median for r in ft.exact_medians(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in draw)).repartition(3), list(draw)).collect()}
        for at, c in enumerate(draw):
            values = sorted(r[at] for r in rows if r[at] is not None)
            if not values:
                assert c not in got
                continue
            want = (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2
            assert got[c] == want or got[c] != got[c] and want != want, (size, c)


def _newton(x, y, w, C):
    """Weighted L2 logistic regression with a free intercept, by Newton steps."""
    X = np.c_[x, np.ones(len(x))]
    b = np.zeros(X.shape[1])
    reg = np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-X @ b))
        grad = C * X.T @ (w * (p - y)) + reg @ b
        b -= np.linalg.solve(C * (X.T * (w * p * (1 - p))) @ X + reg, grad)
    return b


def test_logistic_matches_newton(spark, wide):
    rows = ft.training_rows(wide)
    fitted = md.fit_logistic(rows, LogisticConfig(C=0.5))
    scored = fitted.model.transform(md.weighted(rows, 730)).select("features", md.WEIGHT, ft.TARGET, md.PROB).collect()
    x = np.array([r.features.toArray() for r in scored])
    keep = x.std(axis=0) > 0
    b = _newton(x[:, keep], np.array([r[ft.TARGET] for r in scored]), np.array([r[md.WEIGHT] for r in scored]), 0.5)
    got = fitted.model.solution.coefficients[keep]
    assert got == pytest.approx(b[:-1], abs=1e-7)
    chance = 1 / (1 + np.exp(-np.c_[x[:, keep], np.ones(len(x))] @ b))
    assert [r[md.PROB] for r in scored] == pytest.approx(chance.tolist(), abs=1e-7)


def test_unknown_category_is_all_zeros(spark, wide):
    rows = ft.training_rows(wide)
    model = md.fit_logistic(rows).model
    odd = rows.limit(1).withColumn("handedness_combo", F.lit("U_vs_U"))
    assert float(model.transform(odd).first()["h_handedness_combo"].toArray().sum()) == 0.0


def test_branch_run_saves_and_loads(spark, wide, tmp_path):
    run = md.train_branch(wide, SPLIT, "trees", "Hard", trees=TreeConfig(rounds=3, depth=2, rate=0.3, leaf_hessian=1.0))
    got = {r.split: r for r in run["metrics"].collect()}
    assert set(got) == {"validation", "test"} and got["test"].roc_auc > 0.7
    assert run["calibration"] in ("raw", "isotonic", "sigmoid")
    md.save_run(run, f"{tmp_path}/run")
    back = md.load_run(f"{tmp_path}/run")
    rows = sp.with_split(ft.training_rows(wide, "Hard"), SPLIT).filter("split <> 'train'")
    want = {r.match_id: r[md.PROB] for r in run["predictions"].collect()}
    for r in md.predict_run(back, rows).collect():
        assert r[md.PROB] == pytest.approx(want[r.match_id])


def test_empty_split_raises(spark, wide):
    with pytest.raises(ValueError, match="empty"):
        sp.with_split(wide, SplitConfig.until("2030-01-01", "2031-01-01"), check=True)
    with pytest.raises(ValueError):
        sp.with_split(wide, SplitConfig.until("2031-01-01", "2030-01-01"))


def test_folds(spark, wide):
    folds = sp.time_series_folds(wide.select("match_id", "tourney_date"), n_splits=3).cache()
    assert folds.filter("fold is not null").groupBy("fold").count().select("count").distinct().first()[0] == 40
    train, check = sp.fold_rows(folds, 1)
    assert train.agg(F.max("position")).first()[0] + 1 == check.agg(F.min("position")).first()[0]
    with pytest.raises(ValueError):
        sp.time_series_folds(wide.limit(3).select("match_id", "tourney_date"))


def test_seed_noise(spark):
    run = lambda seed: spark.createDataFrame(
        [("test", 10, 0.5 + seed / 100, 0.6, 0.2, 0.7)], "split string, rows int, accuracy double, log_loss double, brier_score double, roc_auc double")
    got = {r.metric: r for r in md.seed_noise_floor(run, (1, 2, 3)).collect()}
    assert got["accuracy"].std == pytest.approx(0.01) and got["log_loss"].std == pytest.approx(0.0)
