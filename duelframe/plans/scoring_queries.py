"""Scoring closed forms, point snapshots, live states and checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelframe.config import SplitConfig
from duelframe.functions import probability as pr
from duelframe.functions.points import label_count, split_points
from duelframe.operators import snapshots as sn
from duelframe.operators.metrics import binary_metrics, checkpoint_metrics
from duelframe.operators.scoring import scoring_features, with_prematch, with_start_state
from duelframe.operators.splits import split_label
from duelframe.operators.pairing import keep_model_rounds, pair_wide
from duelframe.plans import fixtures as fx
from duelframe.plans import stages
from duelframe.plans.history_queries import FEATURE_SQL, LONG
from duelframe.plans.oracle_base import CONTESTS, POINTS
from duelframe.plans.registry import ORACLES, query, sql

# points fall in January: dates split them as years split contests
POINT_SPLIT = SplitConfig.until("2024-01-01", "2024-01-02", "match_date")

SERVES = """
serves AS (
  SELECT match_num AS id, ("w_1stWon" + "w_2ndWon") / nullif(w_svpt, 0) AS p_a, ("l_1stWon" + "l_2ndWon") / nullif(l_svpt, 0) AS p_b, best_of
  FROM contests)
"""


def score_ctes(source: str) -> list[str]:
    """Set and match probabilities for rows (id, p_a, p_b, best_of), by summing over counted paths."""
    return [
        f"""clipped AS (SELECT id, best_of, CASE WHEN p_a IS NULL THEN 0.5 ELSE least(greatest(p_a, 0.01), 0.99) END::DOUBLE AS pa,
          CASE WHEN p_b IS NULL THEN 0.5 ELSE least(greatest(p_b, 0.01), 0.99) END::DOUBLE AS pb FROM {source})""",
        """holds AS (SELECT *, pow(pa,4)*(15-34*pa+28*pow(pa,2)-8*pow(pa,3))/(1-2*pa+2*pow(pa,2)) AS raw_ha,
          pow(pb,4)*(15-34*pb+28*pow(pb,2)-8*pow(pb,3))/(1-2*pb+2*pow(pb,2)) AS raw_hb FROM clipped)""",
        """trials AS (SELECT 'tb' AS kind, i, (i = 0 OR ((i - 1) // 2) % 2 = 1) AS own FROM range(13) t(i)
          UNION ALL SELECT 'set', i, i % 2 = 0 FROM range(11) t(i))""",
        """stops AS (SELECT 'tb' AS kind, 6 + k AS m, 6 AS wins, false AS lvl FROM range(6) t(k) UNION ALL SELECT 'tb', 12, 6, true
          UNION ALL SELECT 'set', 5 + k, 5, false FROM range(5) t(k) UNION ALL SELECT 'set', 10, 5, true)""",
        """served AS (SELECT s.kind, s.m, count_if(t.own) AS mf, count_if(NOT t.own) AS mo
          FROM (SELECT DISTINCT kind, m FROM stops) s JOIN trials t ON t.kind = s.kind AND t.i < s.m GROUP BY ALL)""",
        """grid AS (SELECT s.kind, s.m, s.wins, s.lvl, mf, mo, j, n.own AS nxt,
            (factorial(mf::INTEGER) / (factorial(j::INTEGER) * factorial((mf - j)::INTEGER)))::DOUBLE
          * (factorial(mo::INTEGER) / (factorial((wins - j)::INTEGER) * factorial((mo - wins + j)::INTEGER)))::DOUBLE AS c
          FROM stops s JOIN served USING (kind, m) JOIN trials n ON n.kind = s.kind AND n.i = s.m, range(13) r(j)
          WHERE j <= mf AND wins - j >= 0 AND wins - j <= mo)""",
        """sided AS (SELECT id, best_of, pa, pb, first, CASE WHEN first = 'A' THEN pa ELSE 1 - pb END AS pf, CASE WHEN first = 'A' THEN 1 - pb ELSE pa END AS po,
            CASE WHEN first = 'A' THEN ha ELSE 1 - hb END AS hf, CASE WHEN first = 'A' THEN 1 - hb ELSE ha END AS ho
          FROM (SELECT *, least(greatest(raw_ha, 0.01), 0.99) AS ha, least(greatest(raw_hb, 0.01), 0.99) AS hb FROM holds), (VALUES ('A'), ('B')) f(first))""",
        """tbs AS (SELECT id, first, sum(c * pow(pf, j) * pow(1 - pf, mf - j) * pow(po, wins - j) * pow(1 - po, mo - wins + j)
            * CASE WHEN lvl THEN (pf*po)/(pf*po + (1-pf)*(1-po)) * (1 - pow(1 - pf*po - (1-pf)*(1-po), 24)) + 0.5 * pow(1 - pf*po - (1-pf)*(1-po), 24)
                   WHEN nxt THEN pf ELSE po END) AS tb
          FROM sided, grid WHERE kind = 'tb' GROUP BY ALL)""",
        """setp AS (SELECT id, first, any_value(best_of) AS best_of, sum(c * pow(hf, j) * pow(1 - hf, mf - j) * pow(ho, wins - j) * pow(1 - ho, mo - wins + j)
            * CASE WHEN lvl THEN hf*ho + (1 - hf*ho - (1-hf)*(1-ho)) * tb WHEN nxt THEN hf ELSE ho END) AS s
          FROM sided JOIN tbs USING (id, first), grid WHERE kind = 'set' GROUP BY id, first)""",
        """won AS (SELECT id, avg(CASE WHEN best_of = 5 THEN pow(z,3)*(10 - 15*z + 6*z*z) ELSE z*z*(3 - 2*z) END) AS win
          FROM (SELECT *, least(greatest(s, 0.01), 0.99) AS z FROM setp) GROUP BY id)""",
    ]


def serves(spark, sf_dir):
    won = lambda s: F.try_divide(F.col(f"{s}_1stWon") + F.col(f"{s}_2ndWon"), F.col(f"{s}_svpt"))
    return fx.contests(spark, sf_dir).select(F.col("match_num").alias("id"), won("w").alias("p_a"), won("l").alias("p_b"), "best_of")


@query("hold_prob", sql([CONTESTS, SERVES, *score_ctes("serves")], "SELECT id, raw_ha AS hold_a, raw_hb AS hold_b FROM holds", ["hold_a", "hold_b"]))
def hold_prob(spark, sf_dir):
    return serves(spark, sf_dir).select("id", pr.hold(F.col("p_a")).alias("hold_a"), pr.hold(F.col("p_b")).alias("hold_b"))


@query("tiebreak_prob", sql([CONTESTS, SERVES, *score_ctes("serves")], """
  SELECT id, max(CASE WHEN first = 'A' THEN tb END) AS a_first, max(CASE WHEN first = 'B' THEN tb END) AS b_first FROM tbs GROUP BY id""", ["a_first", "b_first"]))
def tiebreak_prob(spark, sf_dir):
    a, b = F.col("p_a"), F.col("p_b")
    return serves(spark, sf_dir).select("id", pr.tiebreak(a, b, True).alias("a_first"), pr.tiebreak(a, b, False).alias("b_first"))


@query("set_prob", sql([CONTESTS, SERVES, *score_ctes("serves")], """
  SELECT id, max(CASE WHEN first = 'A' THEN s END) AS a_first, max(CASE WHEN first = 'B' THEN s END) AS b_first FROM setp GROUP BY id""", ["a_first", "b_first"]))
def set_prob(spark, sf_dir):
    a, b = F.col("p_a"), F.col("p_b")
    rows = serves(spark, sf_dir).select("id", "p_a", "p_b", pr.hold(a).alias("h_a"), pr.hold(b).alias("h_b"))
    h_a, h_b = F.col("h_a"), F.col("h_b")
    return rows.select("id", pr.set_win(h_a, h_b, a, b, True).alias("a_first"), pr.set_win(h_a, h_b, a, b, False).alias("b_first"))


@query("match_prob", sql([CONTESTS, SERVES, *score_ctes("serves")], "SELECT id, win AS prob_a FROM won", ["prob_a"]))
def match_prob(spark, sf_dir):
    rows = serves(spark, sf_dir)
    return with_prematch(rows, F.col("p_a"), F.col("p_b"), F.col("best_of"), "prob_a").select("id", "prob_a")


_HIST = ["service_points_won_pct_30", "return_points_won_pct_30", "has_serve_history", "has_return_history"]
HISTORY30 = [
    *LONG,
    "hist AS (SELECT *, " + ", ".join(f"{FEATURE_SQL[n]} AS {n}" for n in _HIST) + " FROM long)",
    "wide AS (SELECT a.match_id, a.tour, a.surface, a.tourney_date, a.best_of, a.label_win AS label_player_a_win, "
    + ", ".join(f"a.{c} AS {c}_a, b.{c} AS {c}_b" for c in _HIST)
    + """ FROM hist a JOIN hist b ON a.match_id = b.match_id AND a.player_id || '__' || a.player_name < b.player_id || '__' || b.player_name
      WHERE a.round NOT IN ('BR', '3RD/4TH'))""",
]
_RATE = lambda kind, side: (
    f"CASE WHEN has_{kind}_history_{side} = 1 THEN coalesce({'service' if kind == 'serve' else 'return'}_points_won_pct_30_{side}, 0.5) ELSE 0.5 END"
)
PRIORS = f"""
priors AS (SELECT match_id AS id, best_of, ({_RATE('serve', 'a')} + (1 - {_RATE('return', 'b')})) / 2 AS p_a,
  ({_RATE('serve', 'b')} + (1 - {_RATE('return', 'a')})) / 2 AS p_b FROM wide)
"""


def _history_wide(spark, sf_dir):
    return keep_model_rounds(pair_wide(stages.player_track(spark, sf_dir)))


@query("markov_features", sql([*HISTORY30, PRIORS, *score_ctes("priors")], """
  SELECT match_id, (has_serve_history_a = 1 AND has_serve_history_b = 1)::INTEGER AS has_serve_history,
    (has_return_history_a = 1 AND has_return_history_b = 1)::INTEGER AS has_return_history,
    win AS markov_match_win_prob_a, 1 - win AS markov_match_win_prob_b, 2 * win - 1 AS delta_markov_match_win
  FROM wide JOIN won ON id = match_id""", ["markov_match_win_prob_a", "markov_match_win_prob_b", "delta_markov_match_win"]))
def markov(spark, sf_dir):
    return scoring_features(_history_wide(spark, sf_dir)).select(
        "match_id", "has_serve_history", "has_return_history", "markov_match_win_prob_a", "markov_match_win_prob_b", "delta_markov_match_win"
    )


def metric_sql(source: str, groups: str, y: str, p: str, edge: float = 2.220446049250313e-16) -> list[str]:
    """CTEs m (metrics) and a (AUC by mid-ranks) over ``source``."""
    safe = f"least(greatest({p}, {edge}), 1 - {edge})"
    return [
        f"""m AS (SELECT {groups}, count(*)::BIGINT AS rows, avg((({p} >= 0.5)::INTEGER = {y})::INTEGER) AS accuracy,
          avg(-CASE WHEN {y} = 1 THEN ln({safe}) ELSE ln(1 - {safe}) END) AS log_loss, avg(pow({p} - {y}, 2)) AS brier_score,
          avg({y}) AS positive_rate, avg({p}) AS avg_pred_prob FROM {source} GROUP BY {groups})""",
        f"""sc AS (SELECT {groups}, {p} AS p, count_if({y} = 1) AS pos, count_if({y} = 0) AS neg FROM {source} GROUP BY {groups}, {p})""",
        f"""cum AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {groups} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM sc)""",
        f"""a AS (SELECT {groups}, (sum(pos * (below + neg / 2.0))::DOUBLE / nullif(sum(pos)::DOUBLE * sum(neg)::DOUBLE, 0)) AS roc_auc FROM cum GROUP BY {groups})""",
    ]


METRICS = ["accuracy", "log_loss", "brier_score", "positive_rate", "avg_pred_prob", "roc_auc"]
_SPLIT_SQL = "CASE WHEN tourney_date <= DATE '1999-12-31' THEN 'train' WHEN tourney_date <= DATE '2000-12-31' THEN 'validation' ELSE 'test' END"


@query("start_state_eval", sql([*HISTORY30, PRIORS, *score_ctes("priors"),
    f"""start AS (SELECT tour, surface, {_SPLIT_SQL} AS split, label_player_a_win AS y, round(least(greatest(win, 0.000001), 0.999999), 12) AS p
        FROM wide JOIN won ON id = match_id WHERE {_SPLIT_SQL} <> 'train')""",
    *metric_sql("start", "tour, surface, split", "y", "p", 1e-6)],
    "SELECT * FROM m JOIN a USING (tour, surface, split)", METRICS))
def start_state(spark, sf_dir):
    """Pre-match scoring probability judged per branch on validation and test rows."""
    scored = scoring_features(_history_wide(spark, sf_dir)).select(
        "tour", "surface", split_label(fx.SPLIT).alias("split"), F.col("label_player_a_win").alias("y"),
        # equal inputs must tie, whatever the order of summation
        F.round(F.least(F.greatest("markov_match_win_prob_a", F.lit(1e-6)), F.lit(1 - 1e-6)), 12).alias("p"),
    ).filter("split <> 'train'")
    return binary_metrics(scored, ["tour", "surface", "split"], "y", "p", 1e-6)


def _kept(rate: str) -> str:
    return f"least(greatest({rate}, 0.01), 0.99)"


_ROUNDED = f"""
rounded AS (SELECT match_id AS id, best_of, round({_kept(f"({_kept(_RATE('serve', 'a'))} + (1 - {_kept(_RATE('return', 'b'))})) / 2")}, 4) AS p_a,
  round({_kept(f"({_kept(_RATE('serve', 'b'))} + (1 - {_kept(_RATE('return', 'a'))})) / 2")}, 4) AS p_b FROM wide)
"""


@query("start_state_rounded", sql([*HISTORY30, _ROUNDED, *score_ctes("rounded"),
    f"""start AS (SELECT tour, surface, {_SPLIT_SQL} AS split, label_player_a_win AS y, round(least(greatest(win, 0.000001), 0.999999), 12) AS p
        FROM wide JOIN won ON id = match_id WHERE {_SPLIT_SQL} <> 'train')""",
    *metric_sql("start", "tour, surface, split", "y", "p", 1e-6)],
    "SELECT * FROM m JOIN a USING (tour, surface, split)", METRICS))
def start_state_rounded(spark, sf_dir):
    """The live model at the start of a match, which rounds its inputs to four places, judged per branch."""
    scored = with_start_state(_history_wide(spark, sf_dir), "_win").select(
        "tour", "surface", split_label(fx.SPLIT).alias("split"), F.col("label_player_a_win").alias("y"),
        F.round(F.least(F.greatest("_win", F.lit(1e-6)), F.lit(1 - 1e-6)), 12).alias("p"),
    ).filter("split <> 'train'")
    return binary_metrics(scored, ["tour", "surface", "split"], "y", "p", 1e-6)


COUNTS = """
counts AS (
  SELECT match_id, pt AS point_index,
    coalesce(sum((svr = 1)::INTEGER) OVER w, 0)::BIGINT AS p1_service_points_played_before,
    coalesce(sum((svr = 1 AND ptwinner IS NOT DISTINCT FROM 1)::INTEGER) OVER w, 0)::BIGINT AS p1_service_points_won_before,
    coalesce(sum((svr = 2)::INTEGER) OVER w, 0)::BIGINT AS p2_service_points_played_before,
    coalesce(sum((svr = 2 AND ptwinner IS NOT DISTINCT FROM 2)::INTEGER) OVER w, 0)::BIGINT AS p2_service_points_won_before
  FROM points WINDOW w AS (PARTITION BY match_id ORDER BY pt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""
_COUNT_NAMES = list(sn.SERVICE_COUNTS)


@query("prior_service_counts", sql([POINTS, COUNTS], "SELECT match_id, point_index, " + ", ".join(_COUNT_NAMES) + " FROM counts"))
def service_counts(spark, sf_dir):
    return sn.prior_service_counts(sn.point_states(fx.points(spark, sf_dir))).select("match_id", "point_index", *_COUNT_NAMES)


@query("bayes_update", sql([POINTS, COUNTS], """
  SELECT match_id, point_index, least(greatest((48 * 0.5 + p1_service_points_won_before) / (48 + p1_service_points_played_before), 0.01), 0.99)::DOUBLE AS live_1,
    least(greatest((48 * 0.5 + p2_service_points_won_before) / (48 + p2_service_points_played_before), 0.01), 0.99)::DOUBLE AS live_2,
    CASE WHEN p1_service_points_won_before + point_index % 3 > p1_service_points_played_before THEN 'won exceeds played' END AS problem
  FROM counts""", ["live_1", "live_2"]))
def bayes(spark, sf_dir):
    counts = sn.prior_service_counts(sn.point_states(fx.points(spark, sf_dir)))
    c = F.col
    return counts.select(
        "match_id", "point_index",
        *[pr.shrink(F.lit(0.5), c(f"p{n}_service_points_won_before"), c(f"p{n}_service_points_played_before")).alias(f"live_{n}") for n in (1, 2)],
        pr.count_problem(c("p1_service_points_won_before") + c("point_index") % 3, c("p1_service_points_played_before")).alias("problem"),
    )


@query("point_score_parse", sql([POINTS], """
  SELECT match_id, pt AS point_index, CASE WHEN svr = 2 THEN b ELSE a END AS points_1, CASE WHEN svr = 2 THEN a ELSE b END AS points_2,
    CASE txt WHEN 'Love' THEN 0 WHEN '' THEN 0 WHEN ' adv ' THEN 4 WHEN '7' THEN 7 WHEN '30' THEN 2 END::INTEGER AS label_points
  FROM (SELECT *, split_part(pts, '-', 1) AS a, split_part(pts, '-', 2) AS b,
    ['Love', '', ' adv ', '7', 'x?', '30'][pt % 6 + 1] AS txt FROM points)"""))
def parse_points(spark, sf_dir):
    labels = F.array(*[F.lit(x) for x in ("Love", "", " adv ", "7", "x?", "30")])
    both = split_points(F.col("Pts"), F.col("Svr"))
    return fx.points(spark, sf_dir).select(
        "match_id", F.col("Pt").alias("point_index"), both.first.alias("points_1"), both.second.alias("points_2"),
        label_count(F.element_at(labels, (F.col("Pt") % 6 + 1).cast("int"))).cast("int").alias("label_points"),
    )


@query("tiebreak_flag", sql([POINTS], """
  SELECT match_id, pt AS point_index, (pt % 5 IN (0, 1, 4) AND (pt % 7 = 0 OR (gm1 = gm2 AND gm1 + 2 >= 6)))::BIGINT AS is_tiebreak_point FROM points"""))
def tiebreak_points(spark, sf_dir):
    """Without an explicit flag: a tiebreak set, and unusual labels or late level games."""
    pt = F.col("Pt")
    marks = F.array(F.lit("1"), F.lit(" true "), F.lit("no"), F.lit(None), F.lit("Y"))
    points = fx.points(spark, sf_dir).drop("TB?").withColumns({
        "TbSet": F.element_at(marks, (pt % 5 + 1).cast("int")),
        "Pts": F.when(pt % 7 == 0, "7-5").otherwise(F.col("Pts")), "Gm1": F.col("Gm1") + 2, "Gm2": F.col("Gm2") + 2,
    })
    return sn.point_states(points).select("match_id", "point_index", "is_tiebreak_point")


SNAPSHOTS = """
lastp AS (SELECT p.*, m.best_of, CASE WHEN svr = 2 THEN split_part(pts, '-', 2) ELSE split_part(pts, '-', 1) END AS l1,
    CASE WHEN svr = 2 THEN split_part(pts, '-', 1) ELSE split_part(pts, '-', 2) END AS l2
  FROM points p JOIN meta m USING (match_id) QUALIFY row_number() OVER (PARTITION BY p.match_id ORDER BY pt DESC) = 1),
moved AS (SELECT *, CASE l1 WHEN '15' THEN 1 WHEN '30' THEN 2 WHEN '40' THEN 3 ELSE 0 END + (ptwinner = 1)::INTEGER AS q1,
    CASE l2 WHEN '15' THEN 1 WHEN '30' THEN 2 WHEN '40' THEN 3 ELSE 0 END + (ptwinner = 2)::INTEGER AS q2,
    gm1 + (ptwinner = 1)::INTEGER AS n1, gm2 + (ptwinner = 2)::INTEGER AS n2 FROM lastp),
labels AS (SELECT match_id, CASE WHEN ptwinner IS NULL OR greatest(q1, q2) < 4 OR abs(q1 - q2) < 2 THEN NULL
    WHEN n1 >= 6 AND n1 - n2 >= 2 AND set1 + 1 >= best_of // 2 + 1 THEN 1 WHEN n2 >= 6 AND n2 - n1 >= 2 AND set2 + 1 >= best_of // 2 + 1 THEN 2
    WHEN n1 >= 6 AND n1 - n2 >= 2 AND set2 >= best_of // 2 + 1 THEN 2 WHEN n2 >= 6 AND n2 - n1 >= 2 AND set1 >= best_of // 2 + 1 THEN 1 END::BIGINT AS match_winner_player FROM moved),
snaps AS (
  SELECT p.match_id || '::' || pt AS snapshot_id, p.match_id, tour, match_date, tournament, round, surface, best_of, final_tiebreak_rule,
    player1_name, player2_name, pt::BIGINT AS point_index, source_file, set1 AS sets_1, set2 AS sets_2, gm1 AS games_1, gm2 AS games_2,
    CASE WHEN svr = 2 THEN split_part(pts, '-', 2) ELSE split_part(pts, '-', 1) END AS points_1,
    CASE WHEN svr = 2 THEN split_part(pts, '-', 1) ELSE split_part(pts, '-', 2) END AS points_2,
    0::BIGINT AS is_tiebreak_point, svr AS server_player, CASE svr WHEN 1 THEN 'A' ELSE 'B' END AS server,
    p1_service_points_won_before, p1_service_points_played_before, p2_service_points_won_before, p2_service_points_played_before,
    ptwinner AS point_winner_player, coalesce((ptwinner = 1)::BIGINT, 0) AS label_player1_wins_point,
    match_winner_player, (match_winner_player = 1)::BIGINT AS label_player1_win_match
  FROM points p JOIN meta USING (match_id) JOIN counts c ON c.match_id = p.match_id AND c.point_index = p.pt JOIN labels USING (match_id))
"""


def snapshots(spark, sf_dir):
    return fx.stage(
        spark, sf_dir, "snapshots", lambda: sn.build_snapshots(fx.points(spark, sf_dir), fx.point_meta(spark, sf_dir))
    )


@query("match_label_last_point", sql([POINTS, COUNTS, SNAPSHOTS], "SELECT match_id, match_winner_player FROM labels"))
def last_point(spark, sf_dir):
    meta = sn.match_metadata(fx.point_meta(spark, sf_dir))
    return sn.match_labels(sn.point_states(fx.points(spark, sf_dir)).join(meta, "match_id"))


@query("snapshots", sql([POINTS, COUNTS, SNAPSHOTS], "SELECT * FROM snaps"))
def all_snapshots(spark, sf_dir):
    return snapshots(spark, sf_dir)


_SAMPLE = ["snapshot_id", "match_id", "tour", "match_date", "point_index", "sets_1", "games_1", "games_2", "points_1", "points_2",
           "server", *_COUNT_NAMES, "label_player1_win_match"]


@query("snapshot_sample", sql([POINTS, COUNTS, SNAPSHOTS], f"SELECT {', '.join(_SAMPLE)} FROM snaps ORDER BY match_date, match_id, point_index LIMIT 250"))
def sample(spark, sf_dir):
    """The first 250 snapshots in date order, for inspection."""
    return snapshots(spark, sf_dir).orderBy("match_date", "match_id", "point_index").limit(250).select(*_SAMPLE)


# the synthetic points rarely end a match, so checkpoints are labelled by who won more points
CHECKS = """
leaders AS (SELECT match_id, (count_if(ptwinner = 1) >= count_if(ptwinner = 2))::BIGINT AS leader_1 FROM points GROUP BY match_id),
checks AS (
  SELECT s.* EXCLUDE (label_player1_win_match), leader_1 AS label_player1_win_match,
    CASE WHEN match_date <= DATE '2024-01-01' THEN 'train' WHEN match_date <= DATE '2024-01-02' THEN 'validation' ELSE 'test' END AS split,
    CASE WHEN point_index = 1 THEN 'match_start' WHEN points_1 = '0' AND points_2 = '0' AND games_1 = 0 AND games_2 = 0 THEN 'set_start'
      WHEN points_1 = '0' AND points_2 = '0' AND games_1 + games_2 >= 10 THEN 'late_game_start_total_ge10' END AS checkpoint_type
  FROM snaps s JOIN leaders USING (match_id)
  WHERE split IN ('validation', 'test') AND checkpoint_type IS NOT NULL)
"""


def checkpoint_rows(spark, sf_dir):
    won = lambda n: F.count_if(F.col("point_winner_player") == n)
    snaps = snapshots(spark, sf_dir)
    leaders = snaps.groupBy("match_id").agg((won(1) >= won(2)).cast("long").alias("leader_1"))
    labelled = snaps.join(leaders, "match_id").withColumn("label_player1_win_match", F.col("leader_1")).drop("leader_1")
    return sn.checkpoints(labelled, split_label(POINT_SPLIT))


@query("checkpoints", sql([POINTS, COUNTS, SNAPSHOTS, CHECKS], "SELECT snapshot_id, split, checkpoint_type, label_player1_win_match FROM checks"))
def checkpoints(spark, sf_dir):
    return checkpoint_rows(spark, sf_dir).select("snapshot_id", "split", "checkpoint_type", "label_player1_win_match")


@query("inplay_prob")
def inplay(spark, sf_dir):
    """Every snapshot scored with live counts."""
    return sn.score_snapshots(snapshots(spark, sf_dir)).select(
        "snapshot_id", "prob_player1_win_match", "prob_player1_win_match_problem"
    )


@query("checkpoint_metrics")
def metrics_at_checkpoints(spark, sf_dir):
    return checkpoint_metrics(sn.score_snapshots(checkpoint_rows(spark, sf_dir)))


def _live_oracle() -> list[str]:
    """CTEs ending in ``live`` (snapshot_id, prob): paths of a set and of a game are
    enumerated one by one by recursion, then summed. Snapshots never lie in a tiebreak."""
    game_value = "sum(n * pow(pt, won) * pow(1 - pt, lost) * CASE over WHEN 'win' THEN 1 WHEN 'deuce' THEN pt*pt / (pt*pt + (1-pt)*(1-pt)) ELSE 0 END)"
    ended = "(x >= 6 OR y >= 6) AND abs(x - y) >= 2"
    ctes = [
        """gpath(sx, sy, x, y, won, lost) AS (
          SELECT a, b, a, b, 0, 0 FROM range(4) r(a), range(4) q(b)
          UNION ALL SELECT sx, sy, x + d, y + 1 - d, won + d, lost + 1 - d FROM gpath, (VALUES (0), (1)) v(d)
          WHERE x < 4 AND y < 4 AND NOT (x = 3 AND y = 3))""",
        """gterm AS (SELECT sx, sy, won, lost, CASE WHEN x = 4 THEN 'win' WHEN y = 4 THEN 'lose' ELSE 'deuce' END AS over, count(*) AS n
          FROM gpath WHERE x = 4 OR y = 4 OR (x = 3 AND y = 3) GROUP BY ALL)""",
        f"""spath(sx, sy, srv, x, y, a1, a2, b1, b2) AS (
          SELECT a, b, s, a, b, 0, 0, 0, 0 FROM range(7) r(a), range(7) q(b), (VALUES (0), (1)) v(s) WHERE NOT ((a >= 6 OR b >= 6) AND abs(a - b) >= 2)
          UNION ALL
          SELECT sx, sy, srv, x + d, y + 1 - d,
            a1 + CASE WHEN own AND d = 1 THEN 1 ELSE 0 END, a2 + CASE WHEN own AND d = 0 THEN 1 ELSE 0 END,
            b1 + CASE WHEN NOT own AND d = 1 THEN 1 ELSE 0 END, b2 + CASE WHEN NOT own AND d = 0 THEN 1 ELSE 0 END
          FROM (SELECT *, (x + y - sx - sy + srv) % 2 = 0 AS own FROM spath), (VALUES (0), (1)) v(d)
          WHERE NOT ({ended}) AND NOT (x = 6 AND y = 6))""",
        f"""sterm AS (SELECT sx, sy, srv, CASE WHEN x = 6 AND y = 6 THEN 'tb' WHEN x > y THEN 'win' ELSE 'lose' END AS over,
            (x + y - sx - sy) % 2 AS odd, a1, a2, b1, b2, count(*)::DOUBLE AS n
          FROM spath WHERE ({ended}) OR (x = 6 AND y = 6) GROUP BY ALL)""",
        """st AS (SELECT s.*, (48 * 0.5 + p1_service_points_won_before) / (48 + p1_service_points_played_before)::DOUBLE AS p_a,
            (48 * 0.5 + p2_service_points_won_before) / (48 + p2_service_points_played_before)::DOUBLE AS p_b, snapshot_id AS id,
            CASE WHEN server = 'A' THEN 0 ELSE 1 END AS sv, best_of // 2 + 1 - sets_1 AS ni, best_of // 2 + 1 - sets_2 AS nj,
            CASE points_1 WHEN '15' THEN 1 WHEN '30' THEN 2 WHEN '40' THEN 3 ELSE 0 END AS c1,
            CASE points_2 WHEN '15' THEN 1 WHEN '30' THEN 2 WHEN '40' THEN 3 ELSE 0 END AS c2 FROM snaps s)""",
        *score_ctes("st"),
        """rates AS (SELECT id, pa, pb, raw_ha AS ha, raw_hb AS hb FROM holds)""",
        f"""cur AS (SELECT id, {game_value} AS g FROM (SELECT st.id, c1, c2, CASE WHEN sv = 0 THEN pa ELSE 1 - pb END AS pt FROM st JOIN rates USING (id))
          JOIN gterm ON sx = c1 AND sy = c2 GROUP BY id)""",
        # value of each part of a set from a score: from 0-0 for both servers, and after either result of this game
        """scores AS (
          SELECT id, 'f' || s AS tag, 0 AS x, 0 AS y, s AS srv FROM st, (VALUES (0), (1)) v(s)
          UNION ALL SELECT id, 'w', games_1 + 1, games_2, 1 - sv FROM st UNION ALL SELECT id, 'l', games_1, games_2 + 1, 1 - sv FROM st)""",
        """parts AS (SELECT id, tag, over, odd, sum(n * pow(ha, a1) * pow(1 - ha, a2) * pow(1 - hb, b1) * pow(hb, b2)) AS v
          FROM scores JOIN rates USING (id) JOIN sterm ON sx = x AND sy = y AND sterm.srv = scores.srv GROUP BY ALL)""",
        # the tiebreak opens with the next server when an even number of games is left before it
        """ends AS (SELECT p.id, p.tag, s.srv,
            coalesce(sum(v) FILTER (over = 'win' AND odd = 0), 0) AS win_same, coalesce(sum(v) FILTER (over = 'lose' AND odd = 0), 0) AS lose_same,
            coalesce(sum(v) FILTER (over = 'win' AND odd = 1), 0) AS win_turn, coalesce(sum(v) FILTER (over = 'lose' AND odd = 1), 0) AS lose_turn,
            coalesce(sum(v) FILTER (over = 'tb'), 0) AS level, (s.srv + any_value(12 - s.x - s.y)) % 2 AS opener
          FROM parts p JOIN scores s ON s.id = p.id AND s.tag = p.tag GROUP BY p.id, p.tag, s.srv)""",
        """flow AS (SELECT e.id, e.tag, s.t,
            CASE WHEN s.t = e.srv THEN win_same ELSE win_turn END + CASE WHEN s.t <> e.opener THEN level * tb ELSE 0 END AS w,
            CASE WHEN s.t = e.srv THEN lose_same ELSE lose_turn END + CASE WHEN s.t <> e.opener THEN level * (1 - tb) ELSE 0 END AS l
          FROM ends e JOIN tbs ON tbs.id = e.id AND tbs.first = CASE WHEN e.opener = 0 THEN 'A' ELSE 'B' END, (VALUES (0), (1)) s(t))""",
        "fresh AS (SELECT id, " + ", ".join(
            f"max({k}) FILTER (tag = 'f{s}' AND t = {t}) AS {k}{s}{t}" for k in "wl" for s in (0, 1) for t in (0, 1)) + " FROM flow GROUP BY id)",
    ]
    source = "fresh"
    for level in range(2, 7):
        cells = []
        for i in range(1, 4):
            j = level - i
            if 1 <= j <= 3:
                for s in (0, 1):
                    won = lambda t: "1" if i == 1 else f"m{i - 1}{j}{t}"  # noqa: E731, B023
                    lost = lambda t: "0" if j == 1 else f"m{i}{j - 1}{t}"  # noqa: E731, B023
                    cells.append(" + ".join(f"w{s}{t} * {won(t)} + l{s}{t} * {lost(t)}" for t in (0, 1)) + f" AS m{i}{j}{s}")
        ctes.append(f"lev{level} AS (SELECT *, {', '.join(cells)} FROM {source})")
        source = f"lev{level}"
    rows = " UNION ALL ".join(
        f"SELECT id, {i} AS i, {j} AS j, {s} AS s, " + ("1.0" if i == 0 else "0.0" if j == 0 else f"m{i}{j}{s}") + f" AS v FROM {source}"
        for i in range(4) for j in range(4) if i + j for s in (0, 1))
    over = "(greatest({x}, {y}) >= 6 AND abs({x} - {y}) >= 2)"
    branch = lambda tag, x, y: (
        f"SELECT st.id, '{tag}' AS tag, mv.v FROM st JOIN mval mv ON mv.id = st.id AND mv.s = 1 - sv AND mv.i = ni - ({x} > {y})::INTEGER AND mv.j = nj - ({x} < {y})::INTEGER "
        f"WHERE {over.format(x=x, y=y)}"
    )
    ctes += [
        f"mval AS ({rows})",
        f"""after AS ({branch('w', '(games_1 + 1)', 'games_2')} UNION ALL {branch('l', 'games_1', '(games_2 + 1)')}
          UNION ALL SELECT st.id, f.tag, sum(f.w * up.v + f.l * down.v) FROM st JOIN flow f ON f.id = st.id AND f.tag IN ('w', 'l')
            JOIN mval up ON up.id = st.id AND up.i = ni - 1 AND up.j = nj AND up.s = f.t JOIN mval down ON down.id = st.id AND down.i = ni AND down.j = nj - 1 AND down.s = f.t
            GROUP BY st.id, f.tag)""",
        """live AS (SELECT id AS snapshot_id, sum(CASE WHEN tag = 'w' THEN g ELSE 1 - g END * v) AS prob FROM after JOIN cur USING (id) GROUP BY id)""",
    ]
    return ctes


LIVE = _live_oracle()
ORACLES["inplay_prob"] = sql(
    [POINTS, COUNTS, SNAPSHOTS, *LIVE],
    "SELECT snapshot_id, prob AS prob_player1_win_match, NULL::VARCHAR AS prob_player1_win_match_problem FROM live", ["prob_player1_win_match"],
)
ORACLES["checkpoint_metrics"] = sql(
    [POINTS, COUNTS, SNAPSHOTS, CHECKS, *LIVE,
     """judged AS (SELECT c.match_id, c.match_date, c.label_player1_win_match AS y, round(prob, 12) AS p, u.grp, u.val
        FROM checks c JOIN live USING (snapshot_id), LATERAL (VALUES ('split', split), (split || ':checkpoint_type', checkpoint_type), (split || ':tour_surface', tour || '/' || surface)) u(grp, val))""",
     *metric_sql("judged", "grp, val", "y", "p", 1e-6),
     "span AS (SELECT grp, val, count(DISTINCT match_id)::BIGINT AS matches, min(match_date) AS date_min, max(match_date) AS date_max FROM judged GROUP BY ALL)"],
    'SELECT grp AS "group", val AS value, matches, date_min, date_max, rows, accuracy, log_loss, brier_score, positive_rate, avg_pred_prob, roc_auc '
    "FROM m JOIN a USING (grp, val) JOIN span USING (grp, val)", METRICS,
)
