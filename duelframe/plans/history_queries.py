"""Ratings, long view, history windows, pairing and common opponents."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelframe.config import RatingConfig
from duelframe.functions.scores import effective_k, is_void, level_multiplier, margin_multiplier, sets_won
from duelframe.operators import history, longview, pairing
from duelframe.operators.opponents import with_common_opponents
from duelframe.operators.prior import heavy_keys, prior_features
from duelframe.operators.ratings import rating_history
from duelframe.plans import fixtures as fx
from duelframe.plans import stages
from duelframe.plans.oracle_base import CONTESTS, KEPT, long_ctes
from duelframe.plans.registry import query, sql

ID = ["match_id", "player_id"]
LONG = [CONTESTS, KEPT, long_ctes("kept")]
VOID_SQL = " OR ".join(f"upper(score) LIKE '%{t}%'" for t in ("RET", "W/O", "WO", "DEF", "ABN", "UNP", "CANC"))

SETS = f"""
tokens AS (SELECT match_num, score, unnest(regexp_split_to_array(trim(score), '\\s+')) AS tok FROM contests),
games AS (
  SELECT match_num, try_cast(regexp_replace(split_part(tok, '-', 1), '[^0-9]', '', 'g') AS INTEGER) AS g1,
    try_cast(regexp_extract(substr(tok, instr(tok, '-') + 1), '^[0-9]+') AS INTEGER) AS g2
  FROM tokens WHERE instr(tok, '-') > 0),
sets AS (
  SELECT c.match_num, c.score, c.tourney_level, ({VOID_SQL}) AS void,
    CASE WHEN ({VOID_SQL}) OR coalesce(w, 0) + coalesce(l, 0) = 0 THEN 1 ELSE w END::INTEGER AS won,
    CASE WHEN ({VOID_SQL}) OR coalesce(w, 0) + coalesce(l, 0) = 0 THEN 0 ELSE l END::INTEGER AS lost
  FROM contests c LEFT JOIN (SELECT match_num, count_if(g1 > g2) AS w, count_if(g2 > g1) AS l FROM games GROUP BY match_num) g USING (match_num)),
kf AS (
  SELECT match_num, NOT void AS live, won, lost,
    CASE upper(trim(tourney_level)) WHEN 'G' THEN 1.25 WHEN 'M' THEN 1.10 WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.90 WHEN 'D' THEN 0.85 WHEN 'F' THEN 0.85 ELSE 1.0 END::DOUBLE AS level_factor,
    CASE WHEN won - lost >= 3 THEN 1.30 WHEN won - lost = 2 THEN 1.20 ELSE 1.0 END::DOUBLE AS margin_factor
  FROM sets)
"""

# contests of each pool in order; a keyed recursion walks them one by one
ELO = """
chain AS (
  SELECT c.tour, row_number() OVER (PARTITION BY c.tour ORDER BY tourney_date, tourney_id, match_num) AS n,
    tourney_id || '__' || match_num AS match_id, winner_id, loser_id,
    CASE surface WHEN 'HARD' THEN 'Hard' WHEN 'CLAY' THEN 'Clay' ELSE 'Grass' END AS surf,
    24.0::DOUBLE * level_factor * margin_factor AS k, live
  FROM contests c JOIN kf USING (match_num)),
walk(key, tour, n, v, w_pre, l_pre, w_post, l_post, sw_pre, sl_pre, sw_post, sl_post) USING KEY (key) AS (
  SELECT 'start|' || tour, tour, 0::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE,
    NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM (SELECT DISTINCT tour FROM chain)
  UNION
  SELECT CASE slot WHEN 0 THEN 'm|' || match_id WHEN 1 THEN 'o|' || tour || '|' || winner_id WHEN 2 THEN 'o|' || tour || '|' || loser_id
      WHEN 3 THEN 's|' || tour || '|' || surf || '|' || winner_id ELSE 's|' || tour || '|' || surf || '|' || loser_id END,
    tour, n, CASE slot WHEN 1 THEN a + g WHEN 2 THEN b - g WHEN 3 THEN sa + sg WHEN 4 THEN sb - sg END,
    a, b, a + g, b - g, sa, sb, sa + sg, sb - sg
  FROM (
    SELECT *, CASE WHEN live THEN k * (1.0 - 1.0 / (1.0 + pow(10.0, (b - a) / 400.0))) ELSE 0.0 END AS g,
      CASE WHEN live THEN k * (1.0 - 1.0 / (1.0 + pow(10.0, (sb - sa) / 400.0))) ELSE 0.0 END AS sg
    FROM (
      SELECT *, coalesce(swv, 0.7 * a + 0.3 * 1500.0) AS sa, coalesce(slv, 0.7 * b + 0.3 * 1500.0) AS sb
      FROM (
        SELECT c.*, coalesce(ow.v, 1500.0) AS a, coalesce(ol.v, 1500.0) AS b, sw.v AS swv, sl.v AS slv
        FROM (SELECT DISTINCT tour, n FROM walk) cur JOIN chain c ON c.tour = cur.tour AND c.n = cur.n + 1
        LEFT JOIN recurring.walk ow ON ow.key = 'o|' || c.tour || '|' || c.winner_id
        LEFT JOIN recurring.walk ol ON ol.key = 'o|' || c.tour || '|' || c.loser_id
        LEFT JOIN recurring.walk sw ON sw.key = 's|' || c.tour || '|' || c.surf || '|' || c.winner_id
        LEFT JOIN recurring.walk sl ON sl.key = 's|' || c.tour || '|' || c.surf || '|' || c.loser_id))), range(5) r(slot)
  WHERE slot = 0 OR live),
elo AS (SELECT substr(key, 3) AS match_id, * EXCLUDE (key, v, n, tour) FROM walk WHERE key LIKE 'm|%')
"""

RATED = """
rated AS (
  SELECT c.*, w_pre AS winner_elo_pre, l_pre AS loser_elo_pre, w_post AS winner_elo_post, l_post AS loser_elo_post,
    sw_pre AS winner_surface_elo_pre, sl_pre AS loser_surface_elo_pre, sw_post AS winner_surface_elo_post, sl_post AS loser_surface_elo_post
  FROM contests c JOIN elo ON elo.match_id = c.tourney_id || '__' || c.match_num)
"""


@query("score_sets", sql([CONTESTS, SETS], "SELECT match_num, score, won AS sets_won, lost AS sets_lost FROM sets"))
def score_sets(spark, sf_dir):
    return fx.contests(spark, sf_dir).select(
        "match_num", "score", sets_won("score").winner.alias("sets_won"), sets_won("score").loser.alias("sets_lost")
    )


@query("elo_k_multiplier", sql([CONTESTS, SETS], """
  SELECT match_num, live, level_factor, margin_factor, 24.0::DOUBLE * level_factor * margin_factor AS k FROM kf""",
    ["level_factor", "margin_factor", "k"]))
def k_factor(spark, sf_dir):
    c = RatingConfig()
    return fx.contests(spark, sf_dir).select(
        "match_num", (~is_void("score")).alias("live"), level_multiplier("tourney_level", c).alias("level_factor"),
        margin_multiplier("score", c).alias("margin_factor"), effective_k("score", "tourney_level", c).alias("k"),
    )


_O = ["winner_elo_pre", "loser_elo_pre", "winner_elo_post", "loser_elo_post", "elo_diff_pre", "elo_prob_winner_pre"]
_S = ["winner_surface_elo_pre", "loser_surface_elo_pre", "winner_surface_elo_post", "loser_surface_elo_post",
      "surface_elo_diff_pre", "surface_elo_prob_winner_pre"]


@query("elo_overall", sql([CONTESTS, SETS, ELO], """
  SELECT match_id, w_pre AS winner_elo_pre, l_pre AS loser_elo_pre, w_post AS winner_elo_post, l_post AS loser_elo_post,
    w_pre - l_pre AS elo_diff_pre, 1.0 / (1.0 + pow(10.0, (l_pre - w_pre) / 400.0)) AS elo_prob_winner_pre FROM elo""", _O))
def elo_overall(spark, sf_dir):
    rated = stages.rated(spark, sf_dir)
    return rated.select(longview.contest_id(rated).alias("match_id"), *_O)


@query("elo_surface", sql([CONTESTS, SETS, ELO], """
  SELECT elo.match_id, surf AS surface_normalized, sw_pre AS winner_surface_elo_pre, sl_pre AS loser_surface_elo_pre,
    sw_post AS winner_surface_elo_post, sl_post AS loser_surface_elo_post, sw_pre - sl_pre AS surface_elo_diff_pre,
    1.0 / (1.0 + pow(10.0, (sl_pre - sw_pre) / 400.0)) AS surface_elo_prob_winner_pre
  FROM elo JOIN chain USING (match_id)""", _S))
def elo_surface(spark, sf_dir):
    rated = stages.rated(spark, sf_dir)
    return rated.select(longview.contest_id(rated).alias("match_id"), "surface_normalized", *_S)


@query("elo_snapshot", sql([CONTESTS, SETS, ELO, RATED], """
  SELECT tour, tourney_id, match_num, tourney_date AS date, winner_id AS player_id, winner_name AS player_name, winner_elo_pre AS elo_pre, winner_elo_post AS elo_post FROM rated
  UNION ALL SELECT tour, tourney_id, match_num, tourney_date, loser_id, loser_name, loser_elo_pre, loser_elo_post FROM rated""",
    ["elo_pre", "elo_post"]))
def snapshot(spark, sf_dir):
    return rating_history(stages.rated(spark, sf_dir))


_LONG_TEXT = ["match_id", "tour", "tourney_date", "surface", "round", "player_id", "player_name", "player_hand",
              "opponent_id", "opponent_name", "opponent_hand", "label_win"]
_LONG_NUM = ["match_num", "best_of", "minutes", "player_age", "player_rank", "player_rank_points", "opponent_rank_points",
             "aces", "double_faults", "serve_points", "opponent_serve_points", "opponent_first_won"]


@query("long_view", sql(LONG, f"SELECT {', '.join(_LONG_TEXT + _LONG_NUM)} FROM long", _LONG_NUM))
def long_rows(spark, sf_dir):
    return stages.sides(spark, sf_dir).select(*_LONG_TEXT, *_LONG_NUM)


_RATES = [r for r in longview.RATIOS if "elo" not in r]


@query("serve_return_rates", sql(LONG, f"SELECT match_id, player_id, {', '.join(_RATES)} FROM long", _RATES))
def rates(spark, sf_dir):
    return stages.sides(spark, sf_dir).select(*ID, *_RATES)


BY_PLAYER = "PARTITION BY tour, player_id ORDER BY tourney_date, tourney_id, match_num"


def _mean(source: str, rows: int, by: str, least: int = 1) -> str:
    frame = f"OVER ({by} ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({source}) {frame} >= {least} THEN avg({source}) {frame} END"


def _days(agg: str, n: int, part: str = "tour, player_id") -> str:
    return f"{agg} OVER (PARTITION BY {part} ORDER BY tourney_date RANGE BETWEEN INTERVAL {n} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"


_SURF = "PARTITION BY tour, player_id, surface ORDER BY tourney_date, tourney_id, match_num"
_HAND = "PARTITION BY tour, player_id, opponent_hand ORDER BY tourney_date, tourney_id, match_num"
_ROUND = "PARTITION BY tour, player_id, round ORDER BY tourney_date, tourney_id, match_num"
_H2H = "PARTITION BY tour, player_id, opponent_id ORDER BY tourney_date, tourney_id, match_num"
_ALL = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

FEATURE_SQL = {
    "matches_played": f"(row_number() OVER ({BY_PLAYER}) - 1)::BIGINT",
    **{out: _mean(src, 10, BY_PLAYER) for out, src in history.LAST10.items()},
    **{out: _mean(src, 30, BY_PLAYER, 10) for out, (src, _) in history.LAST30.items()},
    **{
        flag: f"(count({src}) OVER ({BY_PLAYER} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) >= 10)::INTEGER"
        for src, flag in history.LAST30.values()
    },
    "previous_match_win": f"lag(label_win) OVER ({BY_PLAYER})",
    "days_since_last_match": f"(tourney_date - lag(tourney_date) OVER ({BY_PLAYER}))::DOUBLE",
    **{f"matches_last_{n}_days": f"{_days('count(*)', n)}::BIGINT" for n in (7, 30, 365)},
    "win_pct_last_365_days": _days("avg(label_win)", 365),
    "surface_match_count": f"(row_number() OVER ({_SURF}) - 1)::BIGINT",
    "has_surface_history": f"(row_number() OVER ({_SURF}) > 5)::INTEGER",
    **{out: _mean(src, 10, _SURF, 5) for out, src in history.SURFACE10.items()},
    "days_since_last_match_surface": f"(tourney_date - lag(tourney_date) OVER ({_SURF}))::DOUBLE",
    "matches_last_30_days_surface": f"{_days('count(*)', 30, 'tour, player_id, surface')}::BIGINT",
    "hand_win_pct_last10": _mean("label_win", 10, _HAND),
    "round_win_pct": f"avg(label_win) OVER ({_ROUND} {_ALL})",
    "h2h_wins": f"coalesce(sum(label_win) OVER ({_H2H} {_ALL}), 0)::BIGINT",
    "h2h_losses": f"(count(*) OVER ({_H2H} {_ALL}) - coalesce(sum(label_win) OVER ({_H2H} {_ALL}), 0))::BIGINT",
    "h2h_win_ratio": f"coalesce(avg(label_win) OVER ({_H2H} {_ALL}), 0.5)",
}
STREAK = f"""
broken AS (SELECT *, sum(1 - label_win) OVER ({BY_PLAYER} {_ALL}) AS lost_before FROM long),
streaks AS (SELECT *, (row_number() OVER (PARTITION BY tour, player_id, coalesce(lost_before, 0) ORDER BY tourney_date, tourney_id, match_num)
    - CASE WHEN coalesce(lost_before, 0) > 0 THEN 1 ELSE 1 END)::DOUBLE AS current_win_streak FROM broken)
"""
WHOLE = {"matches_played", "has_serve_history", "has_return_history", "previous_match_win", "matches_last_7_days",
         "matches_last_30_days", "matches_last_365_days", "surface_match_count", "has_surface_history",
         "matches_last_30_days_surface", "h2h_wins", "h2h_losses"}


def _window_sql(names: list[str], ctes: list[str] = LONG) -> str:
    body = f"SELECT match_id, player_id, {', '.join(f'{FEATURE_SQL[n]} AS {n}' for n in names)} FROM long"
    return sql(ctes, body, [n for n in names if n not in WHOLE])


def _windows(name: str, outs: list[str], build):
    @query(name, _window_sql(outs))
    def run(spark, sf_dir):
        sides = stages.sides(spark, sf_dir)
        return build(sides, heavy_keys(sides, history.PLAYER)).select(*ID, *outs)


def _add(measures, keys=history.PLAYER, day=None):
    return lambda df, heavy: prior_features(df, keys, history.ORDER, measures, day=day, heavy=heavy)


_windows("roll_mean_10", list(history.LAST10), _add(history.roll_mean_10()))
_windows(
    "roll_mean_30", [*history.LAST30, "has_serve_history", "has_return_history"],
    lambda df, heavy: history.history_flags(_add(history.roll_mean_30())(df, heavy)),
)
_windows("expanding_by_round", ["round_win_pct"], _add(history.round_measures(), (*history.PLAYER, "round")))
_windows("lag_prev", ["previous_match_win"], _add(history.previous_row()))
_windows(
    "days_since", ["days_since_last_match", "days_since_last_match_surface"],
    lambda df, heavy: _add(history.surface_measures(), (*history.PLAYER, "surface"), history.DAY)(
        _add(history.previous_row())(df, heavy), heavy
    ).select("*", history.days_since("days_since_last_match"), history.days_since("days_since_last_match_surface", "_previous_surface_day")),
)
_windows(
    "range_counts", [f"matches_last_{n}_days" for n in (7, 30, 365)] + ["matches_last_30_days_surface"],
    lambda df, heavy: _add(history.surface_measures(), (*history.PLAYER, "surface"), history.DAY)(
        _add(history.day_counts(), day=history.DAY)(df, heavy), heavy
    ),
)
_windows("range_mean_365", ["win_pct_last_365_days"], _add(history.win_share_365(), day=history.DAY))
_windows(
    "surface_roll", ["surface_match_count", "has_surface_history", *history.SURFACE10],
    lambda df, heavy: _add(history.surface_measures(), (*history.PLAYER, "surface"), history.DAY)(df, heavy).withColumn(
        "has_surface_history", (F.col("surface_match_count") >= 5).cast("int")
    ),
)
_windows("hand_roll", ["hand_win_pct_last10"], _add(history.hand_measures(), (*history.PLAYER, "opponent_hand")))
_windows("h2h_prior", ["h2h_wins", "h2h_losses", "h2h_win_ratio"], history.with_head_to_head)


STREAK = f"""
numbered_rows AS (SELECT *, row_number() OVER ({BY_PLAYER}) AS rn FROM long),
streaks AS (SELECT *, (rn - 1 - coalesce(max(CASE WHEN label_win = 0 THEN rn END) OVER ({BY_PLAYER} {_ALL}), 0))::DOUBLE AS current_win_streak FROM numbered_rows)
"""


@query("streak", sql([*LONG, STREAK], "SELECT match_id, player_id, current_win_streak FROM streaks"))
def streak(spark, sf_dir):
    sides = stages.sides(spark, sf_dir)
    return history.with_streak(sides, heavy_keys(sides, history.PLAYER)).select(*ID, "current_win_streak")


ELO_EXTRA = ("elo_pre", "elo_post", "surface_elo_pre", "surface_elo_post")
TRACK = [
    CONTESTS, SETS, ELO, RATED,
    "kept AS (SELECT * FROM rated WHERE NOT (upper(score) LIKE '%W/O%' OR upper(score) LIKE '%RET%'))",
    long_ctes("kept", ELO_EXTRA),
    STREAK,
    "track AS (SELECT *, " + ", ".join(f"{v} AS {n}" for n, v in FEATURE_SQL.items()) + " FROM streaks)",
]
TRACK_COLUMNS = [*FEATURE_SQL, "current_win_streak", "player_elo_pre", "player_surface_elo_pre"]


@query("player_track", sql(TRACK, f"SELECT match_id, player_id, {', '.join(TRACK_COLUMNS)} FROM track",
       [n for n in TRACK_COLUMNS if n not in WHOLE]))
def track(spark, sf_dir):
    return stages.player_track(spark, sf_dir).select(*ID, *TRACK_COLUMNS)


_SIDES_AB = [c for c in pairing.CARRIED if c not in ("player_id", "player_name")]
WIDE = [
    *TRACK,
    """wide AS (SELECT a.match_id, a.tour, a.tourney_date, a.surface, a.round, a.best_of, a.tourney_level, """
    + ", ".join(f"a.{c} AS {c}_a, b.{c} AS {c}_b" for c in pairing.CARRIED)
    + """, a.label_win AS label_player_a_win FROM track a JOIN track b ON a.match_id = b.match_id
      AND a.player_id || '__' || a.player_name < b.player_id || '__' || b.player_name)""",
]
_INT_SIDES = {"has_serve_history", "has_return_history", "has_surface_history", "label_win", "matches_played", "previous_match_win",
              "matches_last_7_days", "matches_last_30_days", "matches_last_365_days", "matches_last_30_days_surface", "h2h_wins", "h2h_losses"}
_PAIR_SHOWN = ["player_id", "player_hand", "player_rank", "player_elo_pre", "matches_played", "win_rate_last10", "h2h_wins", "label_win"]


@query("pair_wide", sql(WIDE, "SELECT match_id, tour, tourney_date, round, label_player_a_win, "
       + ", ".join(f"{c}_a, {c}_b" for c in _PAIR_SHOWN) + " FROM wide",
       [f"{c}_{s}" for c in ("player_rank", "player_elo_pre", "win_rate_last10") for s in "ab"]))
def paired(spark, sf_dir):
    return pairing.pair_wide(stages.player_track(spark, sf_dir)).select(
        "match_id", "tour", "tourney_date", "round", "label_player_a_win", *[f"{c}_{s}" for c in _PAIR_SHOWN for s in "ab"]
    )


DELTA_SQL = {
    **{out: f"{src}_a - {src}_b" for out, src in pairing.PLAIN_DELTAS.items()},
    "delta_rank_adv": "player_rank_b - player_rank_a",
    "delta_age_30": "(-abs(player_age_a - 30.0)) - (-abs(player_age_b - 30.0))",
    "delta_age_int": "pow(player_age_a - 30.0, 2) - pow(player_age_b - 30.0, 2)",
    "delta_surface_advantage": "(player_surface_elo_pre_a - player_elo_pre_a) - (player_surface_elo_pre_b - player_elo_pre_b)",
    "has_surface_history": "(has_surface_history_a = 1 AND has_surface_history_b = 1)::INTEGER",
    "h2h_matches_total": "h2h_wins_a + h2h_losses_a",
    "first_meeting": "(h2h_wins_a + h2h_losses_a = 0)::INTEGER",
}
DELTA_INTS = {"has_surface_history", "h2h_matches_total", "first_meeting"} | {
    out for out, src in pairing.PLAIN_DELTAS.items() if src in _INT_SIDES
}
DELTA_DOUBLES = [n for n in DELTA_SQL if n not in DELTA_INTS]


@query("delta_features", sql(WIDE, "SELECT match_id, " + ", ".join(f"{v} AS {n}" for n, v in DELTA_SQL.items()) + " FROM wide", DELTA_DOUBLES))
def deltas(spark, sf_dir):
    return pairing.delta_features(pairing.pair_wide(stages.player_track(spark, sf_dir))).select("match_id", *DELTA_SQL)


CONTEXT_SQL = {
    "handedness_combo": "player_hand_a || '_vs_' || player_hand_b",
    "same_hand": "(player_hand_a = player_hand_b AND player_hand_a <> 'U')::INTEGER",
    "is_clay": "(surface = 'CLAY')::INTEGER",
    "is_grass": "(surface = 'GRASS')::INTEGER",
    "round_ordinal": "CASE round WHEN 'RR' THEN 0 WHEN 'R128' THEN 1 WHEN 'R64' THEN 2 WHEN 'R32' THEN 3 WHEN 'R16' THEN 4 WHEN 'QF' THEN 5 WHEN 'SF' THEN 6 WHEN 'F' THEN 7 END",
    "round_rr": "(round = 'RR')::INTEGER",
}
PLAIN_WIDE = [
    *LONG,
    """wide AS (SELECT a.match_id, a.tour, a.tourney_date, a.surface, a.round, a.best_of, a.player_id AS player_id_a, b.player_id AS player_id_b,
      a.player_hand AS player_hand_a, b.player_hand AS player_hand_b FROM long a JOIN long b ON a.match_id = b.match_id
      AND a.player_id || '__' || a.player_name < b.player_id || '__' || b.player_name)""",
]


@query("context_flags", sql(PLAIN_WIDE, "SELECT match_id, " + ", ".join(f"{v} AS {n}" for n, v in CONTEXT_SQL.items()) + " FROM wide"))
def context(spark, sf_dir):
    return pairing.context_flags(pairing.pair_wide(stages.sides(spark, sf_dir))).select("match_id", *CONTEXT_SQL)


@query("round_filter", sql(PLAIN_WIDE, "SELECT match_id, round, surface FROM wide WHERE round NOT IN ('BR', '3RD/4TH') AND surface IN ('HARD', 'CLAY', 'GRASS')"))
def rounds(spark, sf_dir):
    wide = pairing.keep_model_rounds(pairing.pair_wide(stages.sides(spark, sf_dir)))
    return wide.filter(F.upper(F.trim("surface")).isin("HARD", "CLAY", "GRASS")).select("match_id", "round", "surface")


@query("unknown_rounds", sql(PLAIN_WIDE, "SELECT round, count(*)::BIGINT AS rows FROM wide WHERE round NOT IN ('RR','R128','R64','R32','R16','QF','SF','F','BR','3RD/4TH') GROUP BY round"))
def unknown(spark, sf_dir):
    return pairing.unknown_rounds(pairing.pair_wide(stages.sides(spark, sf_dir)))


def common_ctes(wide: str = "wide") -> list[str]:
    return [
        "asked AS (SELECT DISTINCT tour, player_id_a, player_id_b, tourney_date FROM " + wide + ")",
        """past_a AS (SELECT q.*, h.opponent_id, count(*) AS n, sum(h.label_win) AS w FROM asked q JOIN long h
          ON h.tour = q.tour AND h.player_id = q.player_id_a AND h.tourney_date < q.tourney_date GROUP BY ALL)""",
        """past_b AS (SELECT q.*, h.opponent_id, count(*) AS n, sum(h.label_win) AS w FROM asked q JOIN long h
          ON h.tour = q.tour AND h.player_id = q.player_id_b AND h.tourney_date < q.tourney_date GROUP BY ALL)""",
        """common AS (SELECT a.tour, a.player_id_a, a.player_id_b, a.tourney_date, count(*)::DOUBLE AS common_opp_count,
          sum(a.w) / sum(a.n) - sum(b.w) / sum(b.n) AS delta_common_opp_win_pct,
          (sum(a.n) - sum(b.n))::DOUBLE AS delta_common_opp_matches
          FROM past_a a JOIN past_b b USING (tour, player_id_a, player_id_b, tourney_date, opponent_id) GROUP BY ALL)""",
    ]


_COMMON = ["common_opp_count", "delta_common_opp_win_pct", "delta_common_opp_matches"]


@query("common_opponent", sql([*PLAIN_WIDE, *common_ctes()], """
  SELECT match_id, coalesce(common_opp_count, 0) AS common_opp_count, coalesce(delta_common_opp_win_pct, 0) AS delta_common_opp_win_pct,
    coalesce(delta_common_opp_matches, 0) AS delta_common_opp_matches
  FROM wide LEFT JOIN common USING (tour, player_id_a, player_id_b, tourney_date)""", _COMMON))
def common(spark, sf_dir):
    sides = stages.sides(spark, sf_dir)
    return with_common_opponents(pairing.pair_wide(sides), sides).select("match_id", *_COMMON)
