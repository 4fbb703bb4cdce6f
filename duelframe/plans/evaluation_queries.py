"""Splits, weights, metrics and run comparisons."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from duelframe.operators import experiments as ex
from duelframe.operators import splits as sp
from duelframe.operators.metrics import auc, binary_metrics
from duelframe.operators.models import PROB, calibration_choices
from duelframe.plans import fixtures as fx
from duelframe.plans.oracle_base import CONTESTS, PREDICTIONS, RUNS
from duelframe.plans.registry import query, sql
from duelframe.plans.scoring_queries import METRICS, metric_sql

SPLIT = "CASE WHEN tourney_date <= DATE '1999-12-31' THEN 'train' WHEN tourney_date <= DATE '2000-12-31' THEN 'validation' ELSE 'test' END"
BASE = [CONTESTS, PREDICTIONS, f"parted AS (SELECT *, {SPLIT} AS split FROM predictions)"]
BRANCH = ["tour", "surface"]


def parted(spark, sf_dir):
    return sp.with_split(fx.predictions(spark, sf_dir), fx.SPLIT)


@query("time_split", sql(BASE, "SELECT match_id, split FROM parted"))
def time_split(spark, sf_dir):
    return parted(spark, sf_dir).select("match_id", "split")


@query("branch_split", sql(BASE, "SELECT match_id, split FROM parted WHERE surface = 'CLAY'"))
def branch_split(spark, sf_dir):
    """One surface branch, split by date."""
    return parted(spark, sf_dir).filter("surface = 'CLAY'").select("match_id", "split")


@query("calibration_split", sql(BASE, """
  SELECT match_id, CASE WHEN tourney_date > (SELECT max(tourney_date) FROM parted WHERE split = 'train') - INTERVAL 90 DAY THEN 'calibration' ELSE 'train' END AS part
  FROM parted WHERE split = 'train'"""))
def calibration(spark, sf_dir):
    return sp.calibration_split(parted(spark, sf_dir).filter("split = 'train'")).select("match_id", "part")


_SUMMARY = """count(*)::BIGINT AS rows, sum(y_true)::BIGINT AS positive_labels, sum(1 - y_true)::BIGINT AS negative_labels,
  avg(y_true) AS positive_rate, min(tourney_date) AS date_min, max(tourney_date) AS date_max"""


@query("split_summary", sql(BASE, f"SELECT split, {_SUMMARY} FROM parted GROUP BY split", ["positive_rate"]))
def summary(spark, sf_dir):
    return sp.split_summary(parted(spark, sf_dir), "y_true")


@query("surface_balance", sql(BASE, f"SELECT split, surface, {_SUMMARY} FROM parted GROUP BY split, surface", ["positive_rate"]))
def balance(spark, sf_dir):
    return sp.split_summary(parted(spark, sf_dir), "y_true", ("split", "surface"))


WEIGHTED = """weighted AS (SELECT *, pow(0.5, ((SELECT max(tourney_date) FROM parted WHERE split = 'train') - tourney_date) / 730.0::DOUBLE) AS sample_weight
  FROM parted WHERE split = 'train')"""


@query("recency_weights", sql([*BASE, WEIGHTED], "SELECT match_id, sample_weight FROM weighted", ["sample_weight"]))
def weights(spark, sf_dir):
    return sp.with_recency_weight(parted(spark, sf_dir).filter("split = 'train'")).select("match_id", "sample_weight")


@query("recency_weight_summary", sql([*BASE, WEIGHTED], """
  SELECT min(sample_weight) AS min, max(sample_weight) AS max, avg(sample_weight) AS mean, median(sample_weight) AS median FROM weighted""",
    ["min", "max", "mean", "median"]))
def weight_spread(spark, sf_dir):
    return sp.weight_summary(sp.with_recency_weight(parted(spark, sf_dir).filter("split = 'train'")))


FOLDS = """
placed AS (SELECT *, row_number() OVER (ORDER BY tourney_date, match_id) - 1 AS position, count(*) OVER () AS n FROM parted WHERE split = 'train'),
sized AS (SELECT *, greatest(1, floor(0.10::DOUBLE * n)::BIGINT) AS size FROM placed),
folds AS (SELECT *, CASE WHEN position >= n - 5 * size THEN (position - (n - 5 * size)) // size END::INTEGER AS fold FROM sized)
"""


@query("ts_cv_folds", sql([*BASE, FOLDS], "SELECT match_id, position::BIGINT AS position, fold FROM folds"))
def folds(spark, sf_dir):
    rows = parted(spark, sf_dir).filter("split = 'train'").select("match_id", "tourney_date")
    return sp.time_series_folds(rows).select("match_id", "position", "fold")


@query("cv_summary", sql([*BASE, RUNS, FOLDS,
    """judged AS (SELECT r.model, f.fold, r.y_true AS y, r.prob AS p FROM runs r JOIN folds f ON f.match_id = r.match_id WHERE r.seed = 7 AND fold IS NOT NULL)""",
    *metric_sql("judged", "model, fold", "y", "p"),
    """per_fold AS (SELECT model, -log_loss AS neg_log_loss, accuracy, roc_auc FROM m JOIN a USING (model, fold))"""],
    """SELECT model, avg(neg_log_loss) AS mean_test_neg_log_loss, avg(accuracy) AS mean_test_accuracy, avg(roc_auc) AS mean_test_roc_auc,
      stddev_pop(neg_log_loss) AS std_test_neg_log_loss, stddev_pop(accuracy) AS std_test_accuracy, stddev_pop(roc_auc) AS std_test_roc_auc,
      row_number() OVER (ORDER BY avg(neg_log_loss) DESC, model)::INTEGER AS rank_test_neg_log_loss FROM per_fold GROUP BY model""",
    [f"{s}_test_{m}" for s in ("mean", "std") for m in ("neg_log_loss", "accuracy", "roc_auc")]))
def cv(spark, sf_dir):
    rows = parted(spark, sf_dir).filter("split = 'train'").select("match_id", "tourney_date")
    placed = sp.time_series_folds(rows).filter("fold is not null").select("match_id", "fold")
    judged = fx.scored_runs(spark, sf_dir).filter("seed = 7").join(placed, "match_id")
    scores = binary_metrics(judged, ["model", "fold"], "y_true", "prob").withColumn("neg_log_loss", -F.col("log_loss"))
    return ex.cv_summary(scores, ["model"], ["neg_log_loss", "accuracy", "roc_auc"], "neg_log_loss")


@query("metrics_binary", sql([*BASE, *metric_sql("parted", "tour, split", "y_true", "prob_player_a_win")],
       "SELECT * FROM m JOIN a USING (tour, split)", METRICS))
def metrics(spark, sf_dir):
    return binary_metrics(parted(spark, sf_dir), ["tour", "split"], "y_true", "prob_player_a_win")


@query("auc_exact", sql([*BASE, """ranks AS (SELECT split, y_true, prob_player_a_win AS p FROM parted)""",
    """pairsum AS (SELECT split, y_true, avg(rk) AS rk, count(*) AS n FROM (
        SELECT split, y_true, rank() OVER (PARTITION BY split ORDER BY p) + (count(*) OVER (PARTITION BY split, p) - 1) / 2.0::DOUBLE AS rk FROM ranks) GROUP BY ALL)"""],
    """SELECT b.split, (b.rk - (b.n + 1) / 2.0::DOUBLE) / w.n::DOUBLE AS roc_auc FROM pairsum b JOIN pairsum w ON w.split = b.split AND b.y_true = 1 AND w.y_true = 0""",
    ["roc_auc"]))
def auc_exact(spark, sf_dir):
    return auc(parted(spark, sf_dir), ["split"], "y_true", "prob_player_a_win")


_VT = [f"{s}_{m}" for s in ("validation", "test") for m in ("log_loss", "accuracy", "roc_auc", "brier_score")]
RUN_METRICS = [
    *BASE, RUNS,
    f"run_rows AS (SELECT tour, surface, model, seed, {SPLIT} AS split, y_true AS y, prob AS p FROM runs WHERE {SPLIT} <> 'train')",
    *metric_sql("run_rows", "tour, surface, model, seed, split", "y", "p"),
    "run_metrics AS (SELECT tour, surface, model, seed, " + ", ".join(
        f"max(CASE WHEN split = '{s}' THEN {m} END) AS {s}_{m}" for s in ("validation", "test") for m in ("log_loss", "accuracy", "roc_auc", "brier_score")
    ) + " FROM m JOIN a USING (tour, surface, model, seed, split) GROUP BY tour, surface, model, seed)",
]


def run_metrics(spark, sf_dir):
    """Validation and test metrics of every branch, model and seed, from the scored rows."""

    def build():
        rows = sp.with_split(fx.scored_runs(spark, sf_dir), fx.SPLIT).filter("split <> 'train'")
        long = binary_metrics(rows, [*BRANCH, "model", "seed", "split"], "y_true", "prob")
        return long.groupBy(*BRANCH, "model", "seed").agg(
            *[F.max(F.when(F.col("split") == s, F.col(m))).alias(f"{s}_{m}") for s in ("validation", "test")
              for m in ("log_loss", "accuracy", "roc_auc", "brier_score")]
        )

    return fx.stage(spark, sf_dir, "run_metrics", build)


NOISE = [*RUN_METRICS, "noise AS (" + " UNION ALL ".join(
    f"SELECT tour, surface, model, '{m}' AS metric, avg({m}) AS mean, coalesce(stddev_samp({m}), 0.0) AS std, min({m}) AS min, max({m}) AS max FROM run_metrics WHERE {m} IS NOT NULL GROUP BY tour, surface, model"
    for m in _VT) + ")"]


def noise(spark, sf_dir):
    return ex.noise_floor(run_metrics(spark, sf_dir).drop("seed"), [*BRANCH, "model"], _VT)


@query("noise_floor_summary", sql(NOISE, "SELECT * FROM noise", ["mean", "std", "min", "max"]))
def noise_summary(spark, sf_dir):
    return noise(spark, sf_dir)


_PIVOT = {"test_log_loss": ("mean", "std", "min", "max"), "test_accuracy": ("mean", "std"), "test_roc_auc": ("mean", "std")}
_PIVOT_COLUMNS = [f"{m}_{s}" for m in _PIVOT for s in ("mean", "std", "min", "max")]


@query("noise_floor_pivot", sql(NOISE, "SELECT tour, surface, model, " + ", ".join(
    f"max(CASE WHEN metric = '{m}' THEN {s} END) AS {m}_{s}" for m in _PIVOT for s in ("mean", "std", "min", "max")) + " FROM noise GROUP BY tour, surface, model",
    _PIVOT_COLUMNS))
def noise_pivot(spark, sf_dir):
    return ex.pivot_metrics(noise(spark, sf_dir), [*BRANCH, "model"], list(_PIVOT), ("mean", "std", "min", "max"))


FAMILIES = {"logit": ("logit_baseline", "logit_tuned"), "tree": ("tree_baseline", "tree_tuned")}


@query("branch_winner", sql([*RUN_METRICS,
    "losses AS (SELECT tour, surface, model, validation_log_loss AS loss, list_position(['logit_baseline','logit_tuned','tree_baseline','tree_tuned'], model) AS pr FROM run_metrics WHERE seed = 7)"],
    "SELECT tour, surface, " + ", ".join(f"min(CASE WHEN model = '{m}' THEN loss END) AS {m}_validation_ll" for f in FAMILIES.values() for m in f) + ", "
    + ", ".join(f"(list(model ORDER BY loss, pr) FILTER (WHERE model LIKE '{f}%'))[1] AS best_{f}_model, min(loss) FILTER (WHERE model LIKE '{f}%') AS best_{f}_validation_ll" for f in FAMILIES)
    + ", (list(model ORDER BY loss, pr))[1] AS overall_winner, min(loss) AS overall_best_validation_ll FROM losses GROUP BY tour, surface",
    [*[f"{m}_validation_ll" for f in FAMILIES.values() for m in f], *[f"best_{f}_validation_ll" for f in FAMILIES], "overall_best_validation_ll"]))
def winner(spark, sf_dir):
    losses = run_metrics(spark, sf_dir).filter("seed = 7").select(*BRANCH, "model", F.col("validation_log_loss").alias("loss"))
    return ex.branch_winner(losses, BRANCH, FAMILIES)


COMPARED = [*NOISE, """compared AS (
  SELECT tour, surface, family, loss_before, loss_after, loss_before - loss_after AS improvement, noise_floor_std,
    loss_before - loss_after >= noise_floor_std AS row_improves_by_noise, loss_before - loss_after < -noise_floor_std AS row_regresses_by_noise
  FROM (SELECT tour, surface, split_part(model, '_', 1) AS family, test_log_loss AS loss_before FROM run_metrics WHERE seed = 7 AND model LIKE '%baseline') b
  JOIN (SELECT tour, surface, split_part(model, '_', 1) AS family, test_log_loss AS loss_after FROM run_metrics WHERE seed = 7 AND model LIKE '%tuned') t USING (tour, surface, family)
  JOIN (SELECT tour, surface, split_part(model, '_', 1) AS family, CASE WHEN std < 1e-12 THEN 0.0 ELSE std END AS noise_floor_std FROM noise WHERE metric = 'test_log_loss' AND model LIKE '%baseline') n USING (tour, surface, family))"""]


def _family(df):
    return df.withColumn("family", F.substring_index("model", "_", 1))


def compared(spark, sf_dir):
    runs = _family(run_metrics(spark, sf_dir).filter("seed = 7"))
    keys = [*BRANCH, "family"]
    floor = _family(noise(spark, sf_dir).filter("metric = 'test_log_loss' and model like '%baseline'")).select(
        *keys, F.when(F.col("std") < 1e-12, 0.0).otherwise(F.col("std")).alias("noise_floor_std")
    )
    pick = lambda suffix, out: runs.filter(F.col("model").endswith(suffix)).select(*keys, F.col("test_log_loss").alias(out))
    return ex.threshold_compare(pick("baseline", "loss_before"), pick("tuned", "loss_after"), floor, keys)


@query("threshold_compare", sql(COMPARED, """
  SELECT *, CASE WHEN row_improves_by_noise THEN 'improve>=noise' WHEN row_regresses_by_noise THEN 'regress>noise' ELSE 'within_noise' END AS row_result FROM compared""",
    ["loss_before", "loss_after", "improvement", "noise_floor_std"]))
def threshold(spark, sf_dir):
    return compared(spark, sf_dir)


@query("branch_roll_up", sql(COMPARED, """
  SELECT tour, surface, bool_or(row_improves_by_noise) AS any_model_improves_by_noise, bool_or(row_regresses_by_noise) AS any_model_regresses_by_noise,
    count_if(row_improves_by_noise)::BIGINT AS improving_rows, count_if(row_regresses_by_noise)::BIGINT AS regressing_rows FROM compared GROUP BY tour, surface"""))
def roll_up(spark, sf_dir):
    return ex.branch_roll_up(compared(spark, sf_dir), BRANCH)


@query("gap_compare", sql(RUN_METRICS, """
  SELECT tour, surface, model, gap_before, gap_after, abs(gap_after) < abs(gap_before) AS gap_shrank FROM
    (SELECT tour, surface, model, test_log_loss - validation_log_loss AS gap_before FROM run_metrics WHERE seed = 17 AND model LIKE 'tree%') b
    JOIN (SELECT tour, surface, model, test_log_loss - validation_log_loss AS gap_after FROM run_metrics WHERE seed = 29 AND model LIKE 'tree%') t USING (tour, surface, model)""",
    ["gap_before", "gap_after"]))
def gaps(spark, sf_dir):
    runs = run_metrics(spark, sf_dir).filter("model like 'tree%'")
    keys = [*BRANCH, "model"]
    pick = lambda seed, tag: runs.filter(F.col("seed") == seed).select(
        *keys, F.col("validation_log_loss").alias(f"validation_loss_{tag}"), F.col("test_log_loss").alias(f"test_loss_{tag}"))
    return ex.gap_compare(pick(17, "before"), pick(29, "after"), keys)


@query("calibration_choice", sql([*BASE, """cand AS (
    SELECT tour, split, y_true AS y, method, pr, CASE method WHEN 'raw' THEN p WHEN 'isotonic' THEN least(greatest(floor(p * 20) / 20, 0.025), 0.975) ELSE 0.5 + (p - 0.5) * 0.8 END AS p
    FROM (SELECT tour, split, y_true, prob_player_a_win AS p FROM parted WHERE split = 'validation'), (VALUES ('raw', 1), ('isotonic', 2), ('sigmoid', 3)) c(method, pr))""",
    "per AS (SELECT tour, method, pr, avg(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS loss FROM cand GROUP BY ALL)"],
    "SELECT tour, (list(method ORDER BY round(loss, 12), pr))[1] AS chosen, min(loss) AS validation_log_loss FROM per GROUP BY tour", ["validation_log_loss"]))
def choice(spark, sf_dir):
    """Raw, stepwise and shrunken probabilities: the smallest validation loss wins, earlier methods on ties."""
    p = F.col(PROB)
    rows = parted(spark, sf_dir).filter("split = 'validation'").select("tour", "y_true", PROB)
    steps = F.least(F.greatest(F.floor(p * 20) / 20, F.lit(0.025)), F.lit(0.975))
    versions = {"raw": rows, "isotonic": rows.withColumn(PROB, steps), "sigmoid": rows.withColumn(PROB, 0.5 + (p - 0.5) * 0.8)}
    return calibration_choices(versions, ["tour"])
