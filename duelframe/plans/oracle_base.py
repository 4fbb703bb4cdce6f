"""Shared CTEs of the DuckDB oracles: the derived tables in plain SQL."""

from __future__ import annotations

BOX = ("ace", "df", "svpt", "1stIn", "1stWon", "2ndWon", "SvGms", "bpSaved", "bpFaced")


def _box(line: str, prefix: str) -> str:
    q, d, t, n = f"{line}q", f"{line}d", f"{line}t", f"{line}n"
    values = {
        "ace": f"({q}*{d})//10", "df": f"({q}*{t})//20", "svpt": f"{q}*2", "1stIn": f"({q}*12)//10",
        "1stWon": f"({q}*12*({d}+60))//1000", "2ndWon": f"({q}*8*({t}+40))//1000",
        "SvGms": f"({q}+3)//4", "bpSaved": f"({n}*{d})//10", "bpFaced": n,
    }
    return ", ".join(f'({v})::DOUBLE AS "{prefix}_{k}"' for k, v in values.items())


def _person(a: str, who: str) -> str:
    return f"""{a}.s_suppkey::VARCHAR AS {who}_id,
      CASE WHEN {a}.s_suppkey % 5 = 0 THEN ({a}.s_suppkey % 32 + 1)::VARCHAR END AS {who}_seed,
      NULL::VARCHAR AS {who}_entry, {a}.s_name AS {who}_name,
      CASE {a}.s_nationkey % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'L' ELSE 'U' END AS {who}_hand,
      (170 + {a}.s_nationkey)::DOUBLE AS {who}_ht, NULL::VARCHAR AS {who}_ioc,
      (18 + {a}.s_suppkey % 20)::DOUBLE AS {who}_age, ({a}.s_suppkey + 1)::DOUBLE AS {who}_rank,
      {a}.s_acctbal AS {who}_rank_points"""


CONTESTS = f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_suppkey,
    l_quantity, l_partkey, l_discount, l_tax, l_shipdate, l_returnflag) AS rk FROM lineitem),
wline AS (SELECT * FROM ranked WHERE rk = 1),
lline AS (
  SELECT r.*, row_number() OVER (PARTITION BY r.l_orderkey ORDER BY r.rk) AS pk
  FROM ranked r JOIN wline w ON w.l_orderkey = r.l_orderkey AND r.l_suppkey <> w.l_suppkey),
pairs AS (
  SELECT w.l_orderkey AS ok, w.l_suppkey AS ws, l.l_suppkey AS ls, w.l_returnflag AS rf,
    w.l_quantity::INTEGER AS wq, round(w.l_discount*100)::INTEGER AS wd, round(w.l_tax*100)::INTEGER AS wt, w.l_linenumber AS wn,
    l.l_quantity::INTEGER AS lq, round(l.l_discount*100)::INTEGER AS ld, round(l.l_tax*100)::INTEGER AS lt, l.l_linenumber AS ln
  FROM wline w JOIN lline l ON l.l_orderkey = w.l_orderkey AND l.pk = 1),
base AS (
  SELECT p.*, r_name, o_orderstatus, date_trunc('week', o_orderdate)::DATE AS tourney_date,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'G' WHEN '2' THEN 'M' WHEN '3' THEN 'A' WHEN '4' THEN 'B' ELSE '250' END AS lvl
  FROM pairs p JOIN orders ON o_orderkey = p.ok JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
contests AS (
  SELECT r_name AS tour, 'T' || tourney_date::VARCHAR AS tourney_id, 'Event T' || tourney_date::VARCHAR AS tourney_name,
    CASE rf WHEN 'A' THEN 'HARD' WHEN 'N' THEN 'CLAY' ELSE 'GRASS' END AS surface,
    32.0::DOUBLE AS draw_size, lvl AS tourney_level, tourney_date, ok AS match_num,
    {_person("a", "winner")}, {_person("b", "loser")},
    CASE WHEN o_orderstatus = 'F' AND lvl = 'G' THEN '6-4 6-4 6-4' WHEN o_orderstatus = 'F' THEN '6-4 6-4'
         WHEN o_orderstatus = 'O' THEN '6-7(4) 6-3 6-1' ELSE '6-4 RET' END AS score,
    CASE WHEN lvl = 'G' THEN 5.0 ELSE 3.0 END::DOUBLE AS best_of,
    ['RR','R128','R64','R32','R16','QF','SF','F','BR'][ok % 9 + 1] AS round,
    (wq + lq + 60)::DOUBLE AS minutes, {_box("w", "w")}, {_box("l", "l")}
  FROM base JOIN supplier a ON a.s_suppkey = ws JOIN supplier b ON b.s_suppkey = ls)
"""

_SIDE = ("id", "name", "hand", "ht", "age", "rank", "rank_points", "seed")
_RET = {"serve_points": "svpt", "first_in": "1stIn", "first_won": "1stWon", "second_won": "2ndWon",
        "service_games": "SvGms", "break_points_saved": "bpSaved", "break_points_faced": "bpFaced"}
_MINE = {"aces": "ace", "double_faults": "df", **_RET}


def _long_side(won: bool, extra: tuple[str, ...] = ()) -> str:
    me, other, m, o = ("winner", "loser", "w", "l") if won else ("loser", "winner", "l", "w")
    cols = ["tourney_id || '__' || match_num AS match_id", "tour", "tourney_id", "tourney_name", "surface", "round",
            "tourney_level", "tourney_date", "match_num::DOUBLE AS match_num", "best_of", "minutes"]
    for prefix, who in (("player", me), ("opponent", other)):
        cols += [f"{who}_{f} AS {prefix}_{f}" for f in (*_SIDE, *extra)]
    flag = 1 if won else 0
    cols += [f"{flag} AS is_winner", f"{flag} AS label_win"]
    cols += [f'"{m}_{s}" AS {f}' for f, s in _MINE.items()]
    cols += [f'"{o}_{s}" AS opponent_{f}' for f, s in _RET.items()]
    return f"SELECT {', '.join(cols)} FROM src"


RATIO_SQL = """
  first_in / nullif(serve_points, 0) AS first_serve_in_pct,
  first_won / nullif(first_in, 0) AS first_serve_won_pct,
  serve_points - first_in AS second_serve_attempts,
  second_won / nullif(serve_points - first_in, 0) AS second_serve_won_pct,
  second_won / nullif(service_games, 0) AS second_serve_won_per_service_game,
  aces / nullif(serve_points, 0) AS aces_per_service_point,
  double_faults / nullif(serve_points, 0) AS df_per_service_point,
  aces / nullif(double_faults, 0) AS ace_vs_df,
  break_points_saved / nullif(break_points_faced, 0) AS bp_saved_pct,
  first_won + second_won AS service_points_won,
  (first_won + second_won) / nullif(serve_points, 0) AS service_points_won_pct,
  opponent_first_won + opponent_second_won AS opponent_service_points_won,
  opponent_serve_points - (opponent_first_won + opponent_second_won) AS return_points_won,
  (opponent_serve_points - (opponent_first_won + opponent_second_won)) / nullif(opponent_serve_points, 0) AS return_points_won_pct,
  opponent_break_points_faced - opponent_break_points_saved AS break_points_converted,
  (opponent_break_points_faced - opponent_break_points_saved) / nullif(opponent_break_points_faced, 0) AS bp_conversion_pct
"""


def long_ctes(source: str = "contests", extra: tuple[str, ...] = ()) -> str:
    return f"""
src AS (SELECT * FROM {source}),
sides AS ({_long_side(True, extra)} UNION ALL {_long_side(False, extra)}),
long AS (SELECT *, {RATIO_SQL} FROM sides)
"""


KEPT = "kept AS (SELECT * FROM contests WHERE NOT (upper(score) LIKE '%W/O%' OR upper(score) LIKE '%RET%'))"


POINTS = """
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
gamed AS (SELECT *, (i - 1) // 6 AS g, ((i - 1) // 6) % 12 AS h FROM numbered),
points AS (
  SELECT user_id::VARCHAR AS match_id, i::BIGINT AS pt, ((g // 12) % 2)::BIGINT AS set1, 0::BIGINT AS set2,
    ((h + 1) // 2)::BIGINT AS gm1, (h // 2)::BIGINT AS gm2,
    ['0-0','15-0','15-15','30-15','40-15','40-30'][(i - 1) % 6 + 1] AS pts, (1 + g % 2)::BIGINT AS svr,
    CASE WHEN event_type IN ('purchase','click') THEN 1 WHEN event_type IN ('view','signup') THEN 2 END::BIGINT AS ptwinner,
    'charting-' || CASE WHEN user_id % 2 = 1 THEN 'm' ELSE 'w' END || '-points.csv' AS source_file
  FROM gamed),
meta AS (
  SELECT user_id::VARCHAR AS match_id, 'P' || user_id AS player1_name, 'Q' || user_id AS player2_name,
    min(ts)::DATE AS match_date, 'Open ' || (user_id % 10) AS tournament, 'F' AS round,
    ['Hard','Clay','Grass','Carpet'][user_id % 4 + 1] AS surface,
    CASE WHEN user_id % 2 = 1 THEN 5 ELSE 3 END::BIGINT AS best_of, 'S' AS final_tiebreak_rule,
    CASE WHEN user_id % 2 = 1 THEN 'atp' ELSE 'wta' END AS tour
  FROM events GROUP BY user_id)
"""

PREDICTIONS = """
predictions AS (
  SELECT tourney_id || '__' || match_num AS match_id, tour, tourney_date, surface, match_num,
    ((match_num * 104729) % 1000 < 50 + (((match_num * 7919) % 1000) * 9) // 10)::INTEGER AS y_true,
    (50 + (((match_num * 7919) % 1000) * 9) // 10)::DOUBLE / 1000::DOUBLE AS prob_player_a_win,
    ((50 + (((match_num * 7919) % 1000) * 9) // 10) >= 500)::INTEGER AS pred_player_a_win
  FROM contests)
"""

RUNS = """
runs AS (
  SELECT match_id, tour, tourney_date, surface, match_num, y_true, model, seed,
    (50 + (((match_num * 7919 + (CASE WHEN model_no < 2 THEN model_no * 31 ELSE model_no * 31 + seed END) * 613) % 1000) * 9) // 10)::DOUBLE / 1000::DOUBLE AS prob
  FROM predictions,
    (VALUES ('logit_baseline', 0), ('logit_tuned', 1), ('tree_baseline', 2), ('tree_tuned', 3)) m(model, model_no),
    (VALUES (7), (17), (29), (42), (88)) s(seed))
"""
