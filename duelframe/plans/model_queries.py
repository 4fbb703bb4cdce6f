"""Wide features, preprocessing, and fitted models."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from duelframe.config import TreeConfig
from duelframe.operators import features as ft
from duelframe.operators import models as md
from duelframe.operators.splits import calibration_split, with_split
from duelframe.plans import fixtures as fx
from duelframe.plans import stages
from duelframe.plans.history_queries import (
    CONTEXT_SQL, DELTA_DOUBLES, DELTA_SQL, FEATURE_SQL, LONG, STREAK, WIDE, common_ctes,
)
from duelframe.operators.pairing import CARRIED
from duelframe.plans.registry import query, sql
from duelframe.plans.scoring_queries import PRIORS, score_ctes

_COMMON = ["common_opp_count", "delta_common_opp_win_pct", "delta_common_opp_matches"]
_SCORED = ["markov_match_win_prob_a", "delta_markov_match_win"]
BASELINE_WIDE = [*WIDE[:-1], WIDE[-1].rstrip()[:-1] + " WHERE a.round NOT IN ('BR', '3RD/4TH'))", *common_ctes()]
BASELINE = [*BASELINE_WIDE, PRIORS, *score_ctes("priors")]


@query("baseline_track", sql(BASELINE, "SELECT match_id, label_player_a_win, "
       + ", ".join(f"{v} AS {n}" for n, v in {**CONTEXT_SQL, **DELTA_SQL}.items())
       + ", " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _COMMON)
       + ", win AS markov_match_win_prob_a, 2 * win - 1 AS delta_markov_match_win"
       + " FROM wide JOIN won ON id = match_id LEFT JOIN common USING (tour, player_id_a, player_id_b, tourney_date)",
       [*DELTA_DOUBLES, *_COMMON, *_SCORED]))
def baseline(spark, sf_dir):
    return stages.baseline_track(spark, sf_dir).select("match_id", "label_player_a_win", *CONTEXT_SQL, *DELTA_SQL, *_COMMON, *_SCORED)


def rows(spark, sf_dir):
    """Typed and split rows: a filter and a projection of the written contests, not another copy of them."""
    return with_split(ft.training_rows(stages.baseline_track(spark, sf_dir)), fx.SPLIT)


def part(spark, sf_dir, name):
    return rows(spark, sf_dir).filter(F.col("split") == name)


# history features that need no ratings, so that their oracle needs no recursion
_PLAIN = ["delta_rank_adv", "delta_height", "delta_win_rate_last10", "delta_hand_win_pct_last10",
          "delta_surface_win_pct_last10", "delta_days_since_last_match", "delta_ace_vs_df_last10", "delta_h2h"]
_TRACK_NAMES = [c for c in CARRIED if "elo" not in c]
TRAIN = [
    *LONG, STREAK,
    "track AS (SELECT *, " + ", ".join(f"{v} AS {n}" for n, v in FEATURE_SQL.items()) + " FROM streaks)",
    "wide AS (SELECT a.match_id, a.tourney_level, a.tourney_date, " + ", ".join(f"a.{c} AS {c}_a, b.{c} AS {c}_b" for c in _TRACK_NAMES)
    + """ FROM track a JOIN track b ON a.match_id = b.match_id AND a.player_id || '__' || a.player_name < b.player_id || '__' || b.player_name
      WHERE a.round NOT IN ('BR', '3RD/4TH'))""",
    "model_rows AS (SELECT match_id, tourney_date, tourney_level, player_hand_a || '_vs_' || player_hand_b AS handedness_combo, "
    + ", ".join(f"({DELTA_SQL[c]})::DOUBLE AS {c}" for c in _PLAIN) + " FROM wide)",
    "train AS (SELECT * FROM model_rows WHERE tourney_date <= DATE '1999-12-31')",
    "medians AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, median({c}) AS median FROM train" for c in _PLAIN) + ")",
]


# all inputs, ratings and common opponents included
_INPUT_SQL = {**DELTA_SQL, **CONTEXT_SQL, **{c: f"coalesce({c}, 0)" for c in _COMMON}, "best_of": "best_of"}
_NUMERIC = list(ft.NUMERIC)
ALL_INPUTS = [
    *BASELINE_WIDE,
    f"model_rows AS MATERIALIZED (SELECT match_id, tourney_date, tourney_level, {CONTEXT_SQL['handedness_combo']} AS handedness_combo, "
    + ", ".join(f"({_INPUT_SQL[c]})::DOUBLE AS {c}" for c in _NUMERIC)
    + " FROM wide LEFT JOIN common USING (tour, player_id_a, player_id_b, tourney_date))",
    "train AS MATERIALIZED (SELECT * FROM model_rows WHERE tourney_date <= DATE '1999-12-31')",
    "tall AS (UNPIVOT (SELECT " + ", ".join(f"coalesce({c}, 'nan'::DOUBLE) AS {c}" for c in _NUMERIC) + f" FROM train) ON {', '.join(_NUMERIC)} INTO NAME feature VALUE v)",
    "medians AS (SELECT feature, median(v) FILTER (NOT isnan(v)) AS median FROM tall GROUP BY feature HAVING count(*) FILTER (NOT isnan(v)) > 0)",
]


@query("feature_matrix", sql(ALL_INPUTS, f"SELECT match_id, handedness_combo, tourney_level, {', '.join(_NUMERIC)} FROM model_rows", _NUMERIC))
def feature_matrix(spark, sf_dir):
    return rows(spark, sf_dir).select("match_id", *ft.CATEGORICAL, *_NUMERIC)


def _six(df, *columns):
    """Statistics of ratings agree to six places, as ratings do."""
    return df.select("feature", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in columns])


@query("median_impute", sql(ALL_INPUTS, "SELECT feature, round(median, 6) + 0.0 AS median FROM medians"))
def medians(spark, sf_dir):
    return _six(ft.exact_medians(part(spark, sf_dir, "train"), _NUMERIC), "median")


@query("mode_impute", sql(TRAIN, "SELECT 'handedness_combo' AS feature, (SELECT handedness_combo FROM train GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode "
       "UNION ALL SELECT 'tourney_level', (SELECT tourney_level FROM train GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"))
def mode_fill(spark, sf_dir):
    return ft.modes(part(spark, sf_dir, "train"), ft.CATEGORICAL)


@query("standard_scale", sql(ALL_INPUTS, """
  SELECT feature, round(avg(x), 6) + 0.0 AS mean, CASE WHEN max(x) = min(x) THEN 1.0 ELSE round(stddev_pop(x), 6) END::DOUBLE AS std
  FROM (SELECT feature, CASE WHEN isnan(v) THEN median ELSE v END AS x FROM tall JOIN medians USING (feature)) GROUP BY feature"""))
def scale(spark, sf_dir):
    train = part(spark, sf_dir, "train")
    fills = {r.feature: r.median for r in ft.exact_medians(train, _NUMERIC).collect()}  # one row per column
    return _six(ft.scale_statistics(ft.impute(train, fills), _NUMERIC), "mean", "std")


@query("one_hot", sql([*TRAIN, *[
    f"rank_{c} AS (SELECT {c}, row_number() OVER (ORDER BY count(*) DESC, {c}) AS at FROM train GROUP BY {c})" for c in ft.CATEGORICAL]],
    "SELECT match_id, coalesce(h.at, 0)::BIGINT AS handedness_combo_at, coalesce(l.at, 0)::BIGINT AS tourney_level_at "
    "FROM model_rows LEFT JOIN rank_handedness_combo h USING (handedness_combo) LEFT JOIN rank_tourney_level l USING (tourney_level)"))
def one_hot(spark, sf_dir):
    """Position of the one in each encoded vector (0 for a category not seen in training)."""
    prep = ft.Preprocessor((), {}, {c: "U" for c in ft.CATEGORICAL}, {}, {}, False)
    encode = Pipeline(stages=prep.stages()[:3]).fit(part(spark, sf_dir, "train"))
    return encode.transform(rows(spark, sf_dir)).select(
        "match_id", *[F.array_position(vector_to_array(f"h_{c}"), F.lit(1.0)).alias(f"{c}_at") for c in ft.CATEGORICAL]
    )


_fitted: dict[tuple, object] = {}


def _once(spark, sf_dir, name, build):
    """Fitted models are shared by the queries that report on them."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _fitted:
        _fitted[key] = build()
    return _fitted[key]


def logit(spark, sf_dir):
    return _once(spark, sf_dir, "logit", lambda: md.fit_logistic(part(spark, sf_dir, "train")))


def held_out(spark, sf_dir):
    return calibration_split(part(spark, sf_dir, "train"))


def trees(spark, sf_dir):
    def build():
        parts = held_out(spark, sf_dir)
        return md.fit_trees(parts.filter("part = 'train'"), parts.filter("part = 'calibration'"), TreeConfig())

    return _once(spark, sf_dir, "trees", build)


def scored_trees(spark, sf_dir):
    """Raw tree probabilities of the calibration rows and of validation and test rows."""

    def build():
        held = held_out(spark, sf_dir).filter("part = 'calibration'")
        later = rows(spark, sf_dir).filter("split <> 'train'").withColumn("part", F.col("split"))
        return md.predict(trees(spark, sf_dir).model, held.unionByName(later))

    return fx.stage(spark, sf_dir, "scored_trees", build)


@query("logit_fit_predict")
def logit_predict(spark, sf_dir):
    return md.predict(logit(spark, sf_dir).model, rows(spark, sf_dir).filter("split <> 'train'")).select(
        "match_id", "split", "y_true", md.PROB, "pred_player_a_win"
    )


@query("coefficients")
def coefficients(spark, sf_dir):
    return md.ranked_features(logit(spark, sf_dir), rows(spark, sf_dir))


@query("logit_tune")
def logit_tune(spark, sf_dir):
    return md.tune(part(spark, sf_dir, "train"), md.logistic_grid())[1]


@query("gbt_fit_predict")
def gbt_predict(spark, sf_dir):
    return scored_trees(spark, sf_dir).filter("split <> 'train'").select("match_id", "split", "y_true", md.PROB, "pred_player_a_win")


@query("feature_importance")
def importance(spark, sf_dir):
    return md.ranked_features(trees(spark, sf_dir), rows(spark, sf_dir))


@query("gbt_tune")
def gbt_tune(spark, sf_dir):
    """The whole grid: four numbers of rounds for each of 16 shapes and penalties, on three folds."""
    return md.tune(part(spark, sf_dir, "train"), md.tree_grid(), n_splits=3)[1]


def _calibrated(spark, sf_dir, fit):
    scored = scored_trees(spark, sf_dir)
    calibrator = fit(scored.filter("part = 'calibration'"))
    return md.calibrate(calibrator, scored.filter("part <> 'calibration'")).select("match_id", "split", "y_true", md.PROB)


@query("gbt_isotonic")
def isotonic(spark, sf_dir):
    return _calibrated(spark, sf_dir, md.fit_isotonic)


@query("gbt_sigmoid")
def sigmoid(spark, sf_dir):
    return _calibrated(spark, sf_dir, md.fit_sigmoid)


@query("train_branches")
def branches(spark, sf_dir):
    """Plain and tuned logistic models and trees, the latter calibrated, for every surface of every tour."""
    wide = stages.baseline_track(spark, sf_dir)
    tours = [r.tour for r in wide.select("tour").distinct().orderBy("tour").collect()]  # a branch each
    return md.train_branches(wide, fx.SPLIT, [{"tour": t, "surface": s} for t in tours for s in ("Hard", "Clay", "Grass")])
