"""Independent DuckDB formulations of the registered queries (the correctness oracle).

They read the same parquet views (``orders`` …) and restate every rule in plain SQL with a
*different* formulation from the Spark plan: point-in-time frames become "rank of the day"
plus a range self-join instead of row frames + ``first over day``; the Elo fold becomes a
recursive CTE. Double constants are written in exponent form so DuckDB reads them as DOUBLE
(a plain ``0.7`` is a DECIMAL there).
"""

from __future__ import annotations

from ..operators.team_windows import EXP_DECAY, EXP_WINDOW, exp_weights


def dlit(x: float) -> str:
    return f"{float(x):.17e}"


CONTESTS = """
c0 AS (
  SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS match_date,
    CONCAT('L', CAST(o_orderkey % 10 AS VARCHAR)) AS div,
    CONCAT('T', CAST(o_custkey % 20 AS VARCHAR)) AS home_team,
    CONCAT('T', CAST((o_custkey % 20 + 1 + CAST(FLOOR(o_orderkey / 10) AS BIGINT) % 19) % 20 AS VARCHAR)) AS away_team,
    (o_orderkey * 7 + o_custkey) % 5 AS fthg, (o_orderkey * 11 + o_custkey * 3) % 4 AS ftag,
    CAST(CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE 1 + (o_orderkey * 13 + o_custkey) % 20 END AS BIGINT) AS hs,
    CAST(CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE 1 + (o_orderkey * 5 + o_custkey) % 18 END AS BIGINT) AS aws,
    CAST(CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE (o_orderkey * 3 + o_custkey) % 9 END AS BIGINT) AS hst,
    CAST(CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE (o_orderkey * 9 + o_custkey) % 8 END AS BIGINT) AS ast,
    CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(120 + (o_orderkey * 17) % 400 AS DOUBLE) / 100 END AS b365h,
    CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(280 + (o_orderkey * 31) % 200 AS DOUBLE) / 100 END AS b365d,
    CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(130 + (o_orderkey * 19) % 600 AS DOUBLE) / 100 END AS b365a
  FROM orders),
c1 AS (SELECT *, CAST(year(match_date) - CASE WHEN month(match_date) < 8 THEN 1 ELSE 0 END AS INTEGER) AS sy FROM c0),
c AS (
  SELECT match_id, match_date, div, home_team, away_team, fthg, ftag,
    CASE WHEN fthg > ftag THEN 'H' WHEN fthg < ftag THEN 'A' ELSE 'D' END AS ftr,
    hs, aws, hst, ast, b365h, b365d, b365a,
    make_date(sy, 8, 1) AS season_start,
    CAST(sy AS VARCHAR) || '-' || lpad(CAST((sy + 1) % 100 AS VARCHAR), 2, '0') AS season
  FROM c1)"""

TEAM_LONG = """
tl0 AS (
  SELECT match_id, match_date, div, season_start, season, home_team AS team, away_team AS opponent,
    TRUE AS is_home, fthg AS gf, ftag AS ga, hs AS shots_for, aws AS shots_against,
    hst AS sot_for, ast AS sot_against,
    CASE ftr WHEN 'H' THEN 'W' WHEN 'D' THEN 'D' ELSE 'L' END AS result
  FROM c
  UNION ALL
  SELECT match_id, match_date, div, season_start, season, away_team, home_team, FALSE, ftag, fthg, aws, hs,
    ast, hst, CASE ftr WHEN 'A' THEN 'W' WHEN 'D' THEN 'D' ELSE 'L' END
  FROM c),
tl AS (
  SELECT *, CASE result WHEN 'W' THEN 3 WHEN 'D' THEN 1 ELSE 0 END AS points,
    CAST(result = 'W' AS INTEGER) AS win, CAST(result = 'D' AS INTEGER) AS draw,
    CAST(result = 'L' AS INTEGER) AS loss, CAST(ga = 0 AS INTEGER) AS clean_sheet
  FROM tl0)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def _ranked(name: str, part: str) -> str:
    """rn = position in the stream; np = number of rows dated before the row's day."""
    return f"""
{name} AS (
  SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY match_date, match_id) AS rn,
    rank() OVER (PARTITION BY {part} ORDER BY match_date) - 1 AS np
  FROM tl)"""


def _on(part: str) -> str:
    return " AND ".join(f"p.{k} = t.{k}" for k in part.split(", "))


def _ratio(num: str, den: str) -> str:
    return f"CAST({num} AS DOUBLE) / NULLIF({den}, 0)"


def form_cte(windows=(3, 5, 10)) -> str:
    depth = max(windows)
    cols = []
    for n in windows:
        inw = f"p.rn > t.np - {n}"
        cnt = f"COUNT(CASE WHEN {inw} THEN 1 END)"
        s = lambda x: f"SUM(CASE WHEN {inw} THEN p.{x} END)"
        cols += [f"CAST({s('points')} AS BIGINT) AS form{n}_points",
                 f"{_ratio(s('win'), cnt)} AS form{n}_win_rate",
                 f"CAST({s('gf')} - {s('ga')} AS BIGINT) AS form{n}_goal_diff",
                 f"{_ratio(s('gf'), cnt)} AS form{n}_avg_goals_for",
                 f"{_ratio(s('ga'), cnt)} AS form{n}_avg_goals_against"]
    w = exp_weights(EXP_DECAY, EXP_WINDOW)
    num, den = "0e0", "0e0"
    for k in range(EXP_WINDOW, 0, -1):
        lag = f"MAX(CASE WHEN p.rn = t.np - {k - 1} THEN p.points END)"
        num = f"({num} + COALESCE({dlit(w[k - 1])} * CAST({lag} AS DOUBLE), 0e0))"
        den = f"({den} + CASE WHEN {lag} IS NOT NULL THEN {dlit(w[k - 1])} ELSE 0e0 END)"
    cols.append(f"CASE WHEN {den} > 0 THEN {num} / {den} END AS exp_form")
    valid = f"p.rn > t.np - 10 AND p.shots_for > 0"
    nv = f"COUNT(CASE WHEN {valid} THEN 1 END)"
    sv = lambda x: f"SUM(CASE WHEN {valid} THEN p.{x} END)"
    cols += [f"{_ratio(sv('shots_for'), nv)} AS avg_shots", f"{_ratio(sv('sot_for'), nv)} AS avg_sot",
             f"CASE WHEN {nv} > 0 THEN {_ratio('COALESCE(' + sv('sot_for') + ', 0)', sv('shots_for'))} END AS shot_accuracy",
             f"CASE WHEN {nv} > 0 THEN {_ratio(sv('gf'), sv('shots_for'))} END AS shot_conversion"]
    fb = "p.rn > t.np - 10"
    fcnt = f"COUNT(CASE WHEN {fb} THEN 1 END)"
    fs = lambda x: f"SUM(CASE WHEN {fb} THEN p.{x} END)"
    cols += [f"{fcnt} AS fb_n", f"{fs('win')} AS fb_win", f"{fs('points')} AS fb_pts", f"{fs('gf')} AS fb_gf",
             f"{fs('ga')} AS fb_ga", f"{fs('clean_sheet')} AS fb_cs"]
    return f"""{_ranked('rt', 'div, team')},
form AS (
  SELECT t.match_id, t.team, {', '.join(cols)}
  FROM rt t LEFT JOIN rt p ON {_on('div, team')} AND p.rn <= t.np AND p.rn > t.np - {max(depth, 10)}
  GROUP BY t.match_id, t.team)"""


def venue_cte(n: int = 5) -> str:
    cnt = "COUNT(p.rn)"
    return f"""{_ranked('rv', 'div, team, is_home')},
venue AS (
  SELECT t.match_id, t.team, {_ratio('SUM(p.win)', cnt)} AS venue_win_rate,
    {_ratio('SUM(p.gf)', cnt)} AS venue_avg_goals_for, {_ratio('SUM(p.ga)', cnt)} AS venue_avg_goals_against,
    {_ratio('SUM(p.clean_sheet)', cnt)} AS venue_clean_sheets
  FROM rv t LEFT JOIN rv p ON {_on('div, team, is_home')} AND p.rn <= t.np AND p.rn > t.np - {n}
  GROUP BY t.match_id, t.team)"""


def h2h_cte(n: int = 10) -> str:
    cnt = "COUNT(p.rn)"
    return f"""{_ranked('rh', 'div, team, opponent')},
h2h AS (
  SELECT t.match_id, t.team, {cnt} AS h2h_played, {_ratio('SUM(p.win)', cnt)} AS h2h_win_rate,
    {_ratio('SUM(p.gf)', cnt)} AS h2h_avg_gf
  FROM rh t LEFT JOIN rh p ON {_on('div, team, opponent')} AND p.rn <= t.np AND p.rn > t.np - {n}
  GROUP BY t.match_id, t.team)"""


def streak_cte() -> str:
    """Run entering the row = prior rows after the last breaking prior row (needs ``rt``)."""
    return """
streak AS (
  SELECT t.match_id, t.team,
    CAST(t.np - COALESCE(MAX(CASE WHEN p.win = 0 THEN p.rn END), 0) AS BIGINT) AS win_streak,
    CAST(t.np - COALESCE(MAX(CASE WHEN p.loss = 1 THEN p.rn END), 0) AS BIGINT) AS unbeaten_streak,
    CAST(t.np - COALESCE(MAX(CASE WHEN p.loss = 0 THEN p.rn END), 0) AS BIGINT) AS loss_streak
  FROM rt t LEFT JOIN rt p ON p.div = t.div AND p.team = t.team AND p.rn <= t.np
  GROUP BY t.match_id, t.team, t.np)"""


def season_cte() -> str:
    """Season-to-date with the <3 fallback to the last 10 prior rows (needs ``form``)."""
    return """
sstd AS (
  SELECT t.match_id, t.team, COUNT(p.match_id) AS s_n, SUM(p.win) AS s_win, SUM(p.points) AS s_pts,
    SUM(p.gf) AS s_gf, SUM(p.ga) AS s_ga, SUM(p.clean_sheet) AS s_cs
  FROM tl t LEFT JOIN tl p ON p.div = t.div AND p.team = t.team AND p.season_start = t.season_start
    AND p.match_date < t.match_date
  GROUP BY t.match_id, t.team),
season AS (
  SELECT s.match_id, s.team,
    CAST(CASE WHEN s.s_n >= 3 THEN s.s_n ELSE f.fb_n END AS BIGINT) AS season_played,
    CASE WHEN s.s_n >= 3 THEN CAST(s.s_win AS DOUBLE) / s.s_n ELSE CAST(f.fb_win AS DOUBLE) / NULLIF(f.fb_n, 0) END AS season_win_rate,
    CASE WHEN s.s_n >= 3 THEN CAST(s.s_pts AS DOUBLE) / s.s_n ELSE CAST(f.fb_pts AS DOUBLE) / NULLIF(f.fb_n, 0) END AS season_ppg,
    CASE WHEN s.s_n >= 3 THEN CAST(s.s_gf AS DOUBLE) / s.s_n ELSE CAST(f.fb_gf AS DOUBLE) / NULLIF(f.fb_n, 0) END AS season_avg_goals_for,
    CASE WHEN s.s_n >= 3 THEN CAST(s.s_ga AS DOUBLE) / s.s_n ELSE CAST(f.fb_ga AS DOUBLE) / NULLIF(f.fb_n, 0) END AS season_avg_goals_against,
    CASE WHEN s.s_n >= 3 THEN CAST(s.s_cs AS DOUBLE) / s.s_n ELSE CAST(f.fb_cs AS DOUBLE) / NULLIF(f.fb_n, 0) END AS season_clean_sheets
  FROM sstd s JOIN form f ON f.match_id = s.match_id AND f.team = s.team)"""


def side_all() -> str:
    """All per-side CTEs joined into ``sides(match_id, team, is_home, …)``."""
    return ",".join([CONTESTS, TEAM_LONG, form_cte(), venue_cte(), h2h_cte(), streak_cte(), season_cte(), """
sides AS (
  SELECT t.match_id, t.team, t.is_home, f.* EXCLUDE (match_id, team, fb_n, fb_win, fb_pts, fb_gf, fb_ga, fb_cs),
    v.* EXCLUDE (match_id, team), h.* EXCLUDE (match_id, team), k.* EXCLUDE (match_id, team),
    s.* EXCLUDE (match_id, team)
  FROM tl t JOIN form f USING (match_id, team) JOIN venue v USING (match_id, team)
    JOIN h2h h USING (match_id, team) JOIN streak k USING (match_id, team) JOIN season s USING (match_id, team))"""])


ELO = """
ex AS (
  SELECT match_id, match_date, div, CAST(substr(home_team, 2) AS INTEGER) AS h,
    CAST(substr(away_team, 2) AS INTEGER) AS a, fthg, ftag FROM c),
em AS (SELECT *, row_number() OVER (PARTITION BY div ORDER BY match_date, match_id) AS i FROM ex),
es(div, i, match_id, rh, ra, nh, na, r) AS (
  SELECT DISTINCT div, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE),
    CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), list_transform(range(20), lambda t: CAST(1500 AS DOUBLE)) FROM em
  UNION ALL
  SELECT div, i, match_id, rh, ra, rh + dh, ra + da,
    list_transform(range(20), lambda t: CASE WHEN t = h THEN rh + dh WHEN t = a THEN ra + da ELSE r[t + 1] END)
  FROM (SELECT *, (2e1 * mult) * (sh - eh) AS dh, (2e1 * mult) * (sa - (1e0 - eh)) AS da
        FROM (SELECT *, 1e0 / (1e0 + pow(1e1, (ra - rh - 1e2) / 4e2)) AS eh,
                CASE WHEN fthg > ftag THEN 1e0 WHEN fthg = ftag THEN 5e-1 ELSE 0e0 END AS sh,
                CASE WHEN fthg < ftag THEN 1e0 WHEN fthg = ftag THEN 5e-1 ELSE 0e0 END AS sa,
                CASE WHEN fthg = ftag THEN 1e0 ELSE greatest(1e0, ln(abs(fthg - ftag) + 1) + 1e0) END AS mult
              FROM (SELECT m.div, m.i, m.match_id, m.h, m.a, m.fthg, m.ftag, s.r,
                      s.r[m.h + 1] AS rh, s.r[m.a + 1] AS ra
                    FROM es s JOIN em m ON m.div = s.div AND m.i = s.i + 1)))),
elo AS (SELECT match_id, rh AS home_elo, ra AS away_elo, nh AS home_elo_post, na AS away_elo_post
        FROM es WHERE i > 0)"""


def odds_cols(p: str = "") -> str:
    ok = f"({p}b365h IS NOT NULL AND {p}b365d IS NOT NULL AND {p}b365a IS NOT NULL AND {p}b365h > 0 AND {p}b365d > 0 AND {p}b365a > 0)"
    ih, id_, ia = f"(1e0 / {p}b365h)", f"(1e0 / {p}b365d)", f"(1e0 / {p}b365a)"
    tot = f"({ih} + {id_} + {ia})"
    ph, pd_, pa = f"({ih} / {tot})", f"({id_} / {tot})", f"({ia} / {tot})"
    return (f"CASE WHEN {ok} THEN {ph} END AS odds_prob_home, CASE WHEN {ok} THEN {pd_} END AS odds_prob_draw, "
            f"CASE WHEN {ok} THEN {pa} END AS odds_prob_away, CASE WHEN {ok} THEN {ph} - {pa} END AS odds_home_away_diff, "
            f"CASE WHEN {ok} THEN CAST({ph} > {pa} AS INTEGER) END AS odds_fav_is_home")


def temporal_cols(d: str = "match_date") -> str:
    ss = f"make_date(CAST(year({d}) - CASE WHEN month({d}) < 8 THEN 1 ELSE 0 END AS INTEGER), 8, 1)"
    return (f"CAST(isodow({d}) - 1 AS INTEGER) AS day_of_week, CAST(month({d}) AS INTEGER) AS month, "
            f"CAST(isodow({d}) >= 6 AS INTEGER) AS is_weekend, "
            f"CAST(greatest(1, floor(datediff('day', {ss}, {d}) / 7)) AS INTEGER) AS matchweek")


DIRTY = CONTESTS + """,
dirty0 AS (
  SELECT match_id, div,
    CASE WHEN match_id % 10 = 3 THEN strftime(match_date, '%d/%m/%y')
         WHEN match_id % 10 = 4 THEN strftime(match_date, '%-d/%-m/%Y')
         WHEN match_id % 10 = 6 THEN strftime(match_date, '%-d/%-m/%y')
         ELSE strftime(match_date, '%d/%m/%Y') END AS date_text,
    CASE WHEN match_id % 13 = 0 THEN '  ' || home_team || ' ' ELSE home_team END AS home_team,
    CASE WHEN match_id % 13 = 0 THEN ' ' || away_team || '  ' ELSE away_team END AS away_team,
    CASE WHEN match_id % 89 = 0 THEN NULL ELSE fthg END AS fthg, ftag,
    CASE WHEN match_id % 97 = 0 THEN 'NH' WHEN fthg > ftag THEN 'H' WHEN fthg < ftag THEN 'A' ELSE 'D' END AS ftr,
    hs, aws, hst, ast, b365h, b365d, b365a
  FROM c0),
dirty AS (SELECT * FROM dirty0 UNION ALL SELECT * FROM dirty0 WHERE match_id % 101 = 0),
parsed AS (
  SELECT *, CAST(CASE WHEN regexp_matches(date_text, '/[0-9][0-9]$') THEN try_strptime(date_text, '%d/%m/%y')
                      ELSE try_strptime(date_text, '%d/%m/%Y') END AS DATE) AS match_date
  FROM dirty),
cleaned AS (
  SELECT match_id, div, trim(home_team, ' ') AS home_team, trim(away_team, ' ') AS away_team,
    CAST(fthg AS INTEGER) AS fthg, CAST(ftag AS INTEGER) AS ftag, ftr,
    CAST(hs AS INTEGER) AS hs, CAST(aws AS INTEGER) AS aws, CAST(hst AS INTEGER) AS hst, CAST(ast AS INTEGER) AS ast,
    b365h, b365d, b365a, match_date,
    make_date(CAST(year(match_date) - CASE WHEN month(match_date) < 8 THEN 1 ELSE 0 END AS INTEGER), 8, 1) AS season_start,
    CAST(year(match_date) - CASE WHEN month(match_date) < 8 THEN 1 ELSE 0 END AS VARCHAR) || '-' ||
      lpad(CAST((year(match_date) - CASE WHEN month(match_date) < 8 THEN 1 ELSE 0 END + 1) % 100 AS VARCHAR), 2, '0') AS season
  FROM parsed
  WHERE ftr IN ('H', 'D', 'A') AND match_date IS NOT NULL AND home_team IS NOT NULL AND away_team IS NOT NULL
    AND fthg IS NOT NULL AND ftag IS NOT NULL)"""
