"""Registered queries: ``name → (spark_fn(spark, sf_dir) -> DataFrame, oracle SQL | None)``.

Every query reads the driver's tables (or tables Spark derives from them) in full. Names follow
SURVEY §7; the survey ID each one covers is in ``IDS``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import keys as K
from ..functions import prices as P
from ..operators.elo import elo_current, elo_features, elo_history
from ..operators.perspective import team_long
from ..session import materialize
from ..sources.contests import contests
from . import features as FE
from . import oracle_sql as O

QUERIES: dict = {}
SQL: dict = {}
IDS: dict = {}


def register(name: str, ids: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        IDS[name] = ids
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- U1 team-long view
TL_COLS = ["match_id", "match_date", "div", "season", "team", "opponent", "is_home", "gf", "ga", "result",
           "points", "win", "draw", "loss", "clean_sheet", "shots_for", "shots_against", "sot_for", "sot_against"]


@register("team_long", "U1,J7", O.with_(O.CONTESTS, O.TEAM_LONG) + f" SELECT {', '.join(TL_COLS)} FROM tl")
def q_team_long(spark: SparkSession, sf: str) -> DataFrame:
    return team_long(contests(spark, sf)).select(*TL_COLS)


# ---------------------------------------------------------------- W1–W7 per-side windows
def _side_query(cols: list[str], groups, form_windows=None):
    def fn(spark: SparkSession, sf: str) -> DataFrame:
        tf = FE.side_features(spark, sf, groups)
        return tf.select("match_id", "team", "is_home", *cols)
    return fn


def _side_sql(cols: list[str]) -> str:
    return "WITH " + O.side_all() + f" SELECT match_id, team, is_home, {', '.join(cols)} FROM sides"


FORM_METRICS = ("points", "win_rate", "goal_diff", "avg_goals_for", "avg_goals_against")
for _n in (3, 5, 10):
    _cols = [f"form{_n}_{m}" for m in FORM_METRICS]
    register(f"form{_n}", "U2,W1", _side_sql(_cols))(_side_query(_cols, ["form"]))

_GROUP_COLS = {
    "exp_form": (["exp_form"], ["exp"], "W2"),
    "venue_form": (["venue_win_rate", "venue_avg_goals_for", "venue_avg_goals_against", "venue_clean_sheets"],
                   ["venue"], "W3"),
    "streaks": (["win_streak", "unbeaten_streak", "loss_streak"], ["streaks"], "W4"),
    "season_stats": (["season_played", "season_win_rate", "season_ppg", "season_avg_goals_for",
                      "season_avg_goals_against", "season_clean_sheets"], ["season"], "W5"),
    "shooting": (["avg_shots", "avg_sot", "shot_accuracy", "shot_conversion"], ["shooting"], "W6"),
    "h2h_features": (["h2h_played", "h2h_win_rate", "h2h_avg_gf"], ["h2h"], "W7,J2"),
}
for _name, (_cols, _groups, _ids) in _GROUP_COLS.items():
    register(_name, _ids, _side_sql(_cols))(_side_query(_cols, _groups))


# ---------------------------------------------------------------- B1 all features
def _b1_select() -> str:
    sides = [c for c in FE.SIDE_FEATURES]
    parts = ["c.match_id", "c.match_date", "c.div", "c.home_team", "c.away_team", "c.season"]
    parts += [f"h.{x} AS home_{x}" for x in sides] + [f"a.{x} AS away_{x}" for x in sides]
    parts += [f"h.{x} AS {x}" for x in FE.H2H]
    parts.append(O.odds_cols("c."))
    parts += ["c.ftr AS target", "c.fthg AS home_goals", "c.ftag AS away_goals"]
    ok = "h.form5_points IS NOT NULL AND a.form5_points IS NOT NULL"
    for n, hc, ac in FE.DIFFS:
        hx = ("h." + hc[5:]) if hc.startswith("home_") else ("a." + hc[5:])
        ax = ("a." + ac[5:]) if ac.startswith("away_") else ("h." + ac[5:])
        parts.append(f"CASE WHEN {ok} THEN {hx} - {ax} END AS {n}")
    parts.append(O.temporal_cols("c.match_date"))
    parts.append("c.home_team || '_vs_' || c.away_team || '_' || strftime(c.match_date, '%Y%m%d') AS match_key")
    parts += ["e.home_elo", "e.away_elo", "e.home_elo - e.away_elo AS elo_diff"]
    return ("WITH RECURSIVE " + O.side_all() + "," + O.ELO + ", feat AS (SELECT " + ", ".join(parts) +
            " FROM c JOIN sides h ON h.match_id = c.match_id AND h.is_home"
            " JOIN sides a ON a.match_id = c.match_id AND NOT a.is_home"
            " LEFT JOIN elo e ON e.match_id = c.match_id)")


B1_SQL = _b1_select()
register("all_features", "B1,U3,F2,F3,F7,X3", B1_SQL + " SELECT * FROM feat")(
    lambda spark, sf: FE.match_features(spark, sf))


def _model_ready_sql(leaky: bool = False) -> str:
    clean = ("clean AS (SELECT * FROM feat WHERE home_form5_points IS NOT NULL AND "
             "away_form5_points IS NOT NULL AND home_season_win_rate IS NOT NULL), "
             "cidx AS (SELECT *, row_number() OVER (ORDER BY match_date, match_id) - 1 AS idx, "
             "COUNT(*) OVER () AS n FROM clean), "
             "trn AS (SELECT * FROM cidx WHERE idx < CAST(floor(n * 8e-1) AS BIGINT))")
    src = "clean" if leaky else "trn"
    cols = [f"CAST(COALESCE({c}, (SELECT median({c}) FROM {src})) AS DOUBLE) AS {c}" for c in FE.MODEL_FEATURES]
    return (B1_SQL + ", " + clean + " SELECT " + ", ".join(FE.META) + ", " + ", ".join(cols) + ", "
            + ", ".join(FE.TARGETS) + " FROM clean")


register("model_ready", "B2,A4,U5,D3", _model_ready_sql())(
    lambda spark, sf: FE.model_ready(FE.match_features(spark, sf)))

register("model_ready_leaky", "B2,A4", _model_ready_sql(leaky=True))(
    lambda spark, sf: FE.model_ready(FE.match_features(spark, sf), leaky=True))

register("diff_features", "F2", B1_SQL +
         " SELECT match_id, " + ", ".join(n for n, _, _ in FE.DIFFS) + " FROM feat")(
    lambda spark, sf: FE.match_features(spark, sf, with_elo=False).select("match_id", *[n for n, _, _ in FE.DIFFS]))


# ---------------------------------------------------------------- F scalar functions on contests
def _c_sql(select: str) -> str:
    return O.with_(O.CONTESTS) + f" SELECT {select} FROM c"


register("implied_probs", "F1", _c_sql("match_id, " + O.odds_cols()))(
    lambda spark, sf: contests(spark, sf).select("match_id", *P.implied_probabilities()))

register("temporal", "F3", _c_sql("match_id, " + O.temporal_cols()))(
    lambda spark, sf: contests(spark, sf).select("match_id", *cal.temporal_columns("match_date")))

register("season_label", "F4,F5", _c_sql("match_id, season_start, season"))(
    lambda spark, sf: contests(spark, sf).select("match_id", "season_start", "season"))

register("match_key", "F7", _c_sql("match_id, home_team || '_vs_' || away_team || '_' || "
                                   "strftime(match_date, '%Y%m%d') AS match_key"))(
    lambda spark, sf: contests(spark, sf).select("match_id", K.match_key("home_team", "away_team", "match_date")
                                                 .alias("match_key")))

register("numeric_target", "F15", _c_sql("match_id, ftr, CASE ftr WHEN 'H' THEN 1 WHEN 'D' THEN 0 "
                                         "WHEN 'A' THEN -1 END AS target_num"))(
    lambda spark, sf: contests(spark, sf).select("match_id", "ftr", K.numeric_target("ftr").alias("target_num")))


def _price_sql(p: str) -> str:
    m = O.dlit(1.0 + P.DEFAULT_MARGIN)
    return f"CASE WHEN {p} <= 0 THEN CAST('inf' AS DOUBLE) ELSE round(1e0 / ({p} * {m}), 2) END"


register("prob_to_odds", "F8,F9", O.with_(O.CONTESTS) + ", i AS (SELECT match_id, " + O.odds_cols() + " FROM c) "
         "SELECT match_id, " + f"{_price_sql('odds_prob_home')} AS price_home, {_price_sql('odds_prob_draw')} AS price_draw, "
         f"{_price_sql('odds_prob_away')} AS price_away FROM i")(
    lambda spark, sf: contests(spark, sf).select("match_id", *P.implied_probabilities()).select(
        "match_id", P.prob_to_price("odds_prob_home").alias("price_home"),
        P.prob_to_price("odds_prob_draw").alias("price_draw"), P.prob_to_price("odds_prob_away").alias("price_away")))

register("bookmaker_pick", "F14", O.with_(O.CONTESTS) + ", i AS (SELECT match_id, ftr, " + O.odds_cols() + " FROM c) "
         "SELECT match_id, CASE WHEN greatest(odds_prob_home, odds_prob_draw, odds_prob_away) IS NULL THEN NULL "
         "WHEN odds_prob_home = greatest(odds_prob_home, odds_prob_draw, odds_prob_away) THEN 'H' "
         "WHEN odds_prob_draw = greatest(odds_prob_home, odds_prob_draw, odds_prob_away) THEN 'D' ELSE 'A' END AS pick "
         "FROM i")(
    lambda spark, sf: contests(spark, sf).select("match_id", *P.implied_probabilities()).select(
        "match_id", P.bookmaker_pick().alias("pick")))


# ---------------------------------------------------------------- X Elo
register("elo_history", "X1", "WITH RECURSIVE " + O.CONTESTS + "," + O.ELO +
         " SELECT match_id, home_elo, away_elo, home_elo_post, away_elo_post FROM elo")(
    lambda spark, sf: elo_history(contests(spark, sf)).select("match_id", "home_elo", "away_elo",
                                                               "home_elo_post", "away_elo_post"))

register("elo_current", "X2", "WITH RECURSIVE " + O.CONTESTS + "," + O.ELO + """,
ev AS (SELECT c.div, c.home_team AS team, c.match_date, c.match_id, e.home_elo_post AS rating FROM c JOIN elo e USING (match_id)
       UNION ALL
       SELECT c.div, c.away_team, c.match_date, c.match_id, e.away_elo_post FROM c JOIN elo e USING (match_id))
SELECT div, team, rating FROM (SELECT *, row_number() OVER (PARTITION BY div, team
  ORDER BY match_date DESC, match_id DESC) AS k FROM ev) WHERE k = 1""")(lambda spark, sf: elo_current(elo_history(contests(spark, sf))))

register("elo_features", "X3,J3", "WITH RECURSIVE " + O.CONTESTS + "," + O.ELO +
         " SELECT match_id, home_elo, away_elo, home_elo - away_elo AS elo_diff FROM elo")(
    lambda spark, sf: elo_features(elo_history(contests(spark, sf))))


# ---------------------------------------------------------------- A/O/W10 history queries
from ..operators import history as H  # noqa: E402
from ..operators import quality as Q  # noqa: E402
from ..operators import splits as SP  # noqa: E402
from ..sources.contests import dirty_contests  # noqa: E402

_TL = O.with_(O.CONTESTS, O.TEAM_LONG)

register("team_record", "A1", _TL + """
SELECT div, team,
  COUNT(*) FILTER (WHERE is_home AND result = 'W') AS home_wins, COUNT(*) FILTER (WHERE is_home AND result = 'D') AS home_draws,
  COUNT(*) FILTER (WHERE is_home AND result = 'L') AS home_losses, COUNT(*) FILTER (WHERE NOT is_home AND result = 'W') AS away_wins,
  COUNT(*) FILTER (WHERE NOT is_home AND result = 'D') AS away_draws, COUNT(*) FILTER (WHERE NOT is_home AND result = 'L') AS away_losses,
  COUNT(*) AS matches_played
FROM tl GROUP BY div, team""")(lambda spark, sf: H.team_record(contests(spark, sf)))

register("team_stats", "A3", _TL + """
SELECT div, team, COUNT(*) AS matches, CAST(SUM(win) AS BIGINT) AS wins, CAST(SUM(draw) AS BIGINT) AS draws,
  CAST(SUM(loss) AS BIGINT) AS losses, CAST(SUM(win) AS DOUBLE) / COUNT(*) AS win_rate,
  CAST(SUM(gf) AS BIGINT) AS goals_for, CAST(SUM(ga) AS BIGINT) AS goals_against, CAST(SUM(gf) - SUM(ga) AS BIGINT) AS goal_diff,
  CAST(SUM(gf) AS DOUBLE) / COUNT(*) AS avg_goals_scored, CAST(SUM(ga) AS DOUBLE) / COUNT(*) AS avg_goals_conceded,
  CAST(SUM(CASE WHEN is_home THEN win END) AS DOUBLE) / NULLIF(COUNT(*) FILTER (WHERE is_home), 0) AS home_win_rate,
  CAST(SUM(CASE WHEN NOT is_home THEN win END) AS DOUBLE) / NULLIF(COUNT(*) FILTER (WHERE NOT is_home), 0) AS away_win_rate
FROM tl GROUP BY div, team""")(lambda spark, sf: H.team_stats(contests(spark, sf)))

register("team_list", "U4", O.with_(O.CONTESTS) + """
SELECT DISTINCT div, team FROM (SELECT div, home_team AS team FROM c UNION ALL SELECT div, away_team FROM c)""")(
    lambda spark, sf: H.team_list(contests(spark, sf)))

register("recent_matches", "O1,O9", O.with_(O.CONTESTS) + """
SELECT match_id, match_date, div, home_team, away_team, fthg AS home_goals, ftag AS away_goals, ftr AS result
FROM c ORDER BY match_date DESC, match_id DESC LIMIT 10""")(lambda spark, sf: H.recent_matches(contests(spark, sf)))

register("recent_matches_by_team", "O1", _TL + """
SELECT div, team, CAST(rank AS INTEGER) AS rank, match_id, match_date, opponent, is_home, gf, ga, result FROM (
  SELECT *, row_number() OVER (PARTITION BY div, team ORDER BY match_date DESC, match_id DESC) AS rank FROM tl)
WHERE rank <= 10""")(lambda spark, sf: H.recent_matches_by_team(contests(spark, sf)))

register("h2h_summary", "A2,J2", O.with_(O.CONTESTS) + """,
p AS (SELECT div, least(home_team, away_team) AS pair_lo, greatest(home_team, away_team) AS pair_hi, home_team, ftr FROM c)
SELECT div, pair_lo, pair_hi, COUNT(*) AS total_meetings,
  COUNT(*) FILTER (WHERE (home_team = pair_lo AND ftr = 'H') OR (home_team <> pair_lo AND ftr = 'A')) AS lo_wins,
  COUNT(*) FILTER (WHERE (home_team = pair_lo AND ftr = 'A') OR (home_team <> pair_lo AND ftr = 'H')) AS hi_wins,
  COUNT(*) FILTER (WHERE ftr = 'D') AS draws
FROM p GROUP BY div, pair_lo, pair_hi""")(lambda spark, sf: H.h2h_summary(contests(spark, sf)))

register("h2h_recent", "O2", O.with_(O.CONTESTS) + """
SELECT * FROM (
  SELECT div, least(home_team, away_team) AS pair_lo, greatest(home_team, away_team) AS pair_hi, match_id, match_date,
    home_team, away_team, fthg AS home_goals, ftag AS away_goals, ftr AS result,
    CAST(row_number() OVER (PARTITION BY div, least(home_team, away_team), greatest(home_team, away_team)
                            ORDER BY match_date DESC, match_id DESC) AS INTEGER) AS rank
  FROM c) WHERE rank <= 10""")(lambda spark, sf: H.h2h_recent(contests(spark, sf)))

register("recent_form", "W10", _TL + """
SELECT div, team, string_agg(result, '' ORDER BY match_date, match_id) AS recent_form FROM (
  SELECT *, row_number() OVER (PARTITION BY div, team ORDER BY match_date DESC, match_id DESC) AS k FROM tl)
WHERE k <= 5 GROUP BY div, team""")(lambda spark, sf: H.recent_form(contests(spark, sf)))


# ---------------------------------------------------------------- P/V ingest and quality
def _dirty_parsed(spark, sf):
    return dirty_contests(spark, sf).drop("_true_date").withColumn("match_date", Q.parse_day_first("date_text"))


_CLEAN_COLS = ["match_id", "div", "home_team", "away_team", "fthg", "ftag", "ftr", "hs", "aws", "hst", "ast",
               "b365h", "b365d", "b365a", "match_date", "season_start", "season"]

register("clean_contests", "P1,P2,P3,P4,P5,P7", O.with_(O.DIRTY) + " SELECT * FROM cleaned")(
    lambda spark, sf: Q.clean_contests(dirty_contests(spark, sf)).select(*_CLEAN_COLS))

register("cleaning_report", "P2,P3,P6", O.with_(O.DIRTY) + """
SELECT COUNT(*) AS rows_in, COUNT(*) FILTER (WHERE ftr NOT IN ('H','D','A') OR ftr IS NULL) AS removed_bad_result,
  COUNT(*) FILTER (WHERE ftr IN ('H','D','A') AND (match_date IS NULL OR home_team IS NULL OR away_team IS NULL
                   OR fthg IS NULL OR ftag IS NULL)) AS removed_missing,
  (SELECT COUNT(*) FROM cleaned) AS rows_out, (SELECT min(match_date) FROM cleaned) AS first_date,
  (SELECT max(match_date) FROM cleaned) AS last_date, (SELECT COUNT(DISTINCT home_team) FROM cleaned) AS home_teams
FROM parsed""")(lambda spark, sf: Q.cleaning_report(dirty_contests(spark, sf)))

register("dq_report", "V1,V2,V3,V4,V5,V6,V7", O.with_(O.DIRTY) + """,
nulls AS (
  SELECT * FROM (VALUES ('match_date'), ('home_team'), ('away_team'), ('fthg'), ('ftag'), ('ftr')) v(col)),
agg AS (
  SELECT COUNT(*) FILTER (WHERE match_date IS NULL) AS n_match_date, COUNT(*) FILTER (WHERE home_team IS NULL) AS n_home_team,
    COUNT(*) FILTER (WHERE away_team IS NULL) AS n_away_team, COUNT(*) FILTER (WHERE fthg IS NULL) AS n_fthg,
    COUNT(*) FILTER (WHERE ftag IS NULL) AS n_ftag, COUNT(*) FILTER (WHERE ftr IS NULL) AS n_ftr,
    COUNT(*) FILTER (WHERE ftr NOT IN ('H','D','A')) AS bad_ftr,
    COUNT(*) FILTER (WHERE fthg < 0) AS neg_fthg, COUNT(*) FILTER (WHERE ftag < 0) AS neg_ftag
  FROM parsed),
dups AS (SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS d FROM
  (SELECT COUNT(*) AS n FROM parsed GROUP BY match_date, home_team, away_team)),
ord AS (SELECT COUNT(*) FILTER (WHERE match_date < prev) AS u FROM
  (SELECT match_date, lag(match_date) OVER (ORDER BY match_id) AS prev FROM parsed))
SELECT 'null_values' AS "check", 'match_date' AS "column", n_match_date AS n_bad, CAST(NULL AS VARCHAR) AS detail FROM agg
UNION ALL SELECT 'null_values', 'home_team', n_home_team, NULL FROM agg
UNION ALL SELECT 'null_values', 'away_team', n_away_team, NULL FROM agg
UNION ALL SELECT 'null_values', 'fthg', n_fthg, NULL FROM agg
UNION ALL SELECT 'null_values', 'ftag', n_ftag, NULL FROM agg
UNION ALL SELECT 'null_values', 'ftr', n_ftr, NULL FROM agg
UNION ALL SELECT 'invalid_result', 'ftr', bad_ftr, NULL FROM agg
UNION ALL SELECT 'invalid_value', 'ftr', COUNT(*), ftr FROM parsed WHERE ftr NOT IN ('H','D','A') GROUP BY ftr
UNION ALL SELECT 'negative_goals', 'fthg', neg_fthg, NULL FROM agg
UNION ALL SELECT 'negative_goals', 'ftag', neg_ftag, NULL FROM agg
UNION ALL SELECT 'duplicates', 'match_date,home_team,away_team', d, NULL FROM dups
UNION ALL SELECT 'date_order', 'match_date', u, NULL FROM ord""")(lambda spark, sf: Q.dq_report(_dirty_parsed(spark, sf)))

register("duplicates", "V5", O.with_(O.DIRTY) + """
SELECT match_date, home_team, away_team, COUNT(*) AS copies, COUNT(*) - 1 AS extra
FROM parsed GROUP BY match_date, home_team, away_team HAVING COUNT(*) > 1""")(
    lambda spark, sf: Q.duplicates(_dirty_parsed(spark, sf)))

register("dedup_contests", "R15", O.with_(O.DIRTY) + """
SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY match_date, home_team, away_team ORDER BY match_id) AS k
FROM cleaned) WHERE k = 1""")(
    lambda spark, sf: Q.dedup(Q.clean_contests(dirty_contests(spark, sf)).select(*_CLEAN_COLS)))

register("target_distribution", "V8", O.with_(O.DIRTY) + """
SELECT ftr, COUNT(*) AS n, CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM cleaned) AS share FROM cleaned GROUP BY ftr""")(
    lambda spark, sf: Q.target_distribution(Q.clean_contests(dirty_contests(spark, sf))))

register("contract_quarantine", "P8,D10", O.with_(O.DIRTY) + """
SELECT * FROM (
  SELECT match_id, ftr, fthg, ftag, list_filter([
      CASE WHEN COALESCE(fthg < 0 OR ftag < 0, FALSE) THEN 'goals_negative' END,
      CASE WHEN fthg IS NULL OR ftag IS NULL THEN 'goals_missing' END,
      CASE WHEN NOT COALESCE(regexp_full_match(ftr, '[HDA]'), FALSE) THEN 'result_pattern' END,
      CASE WHEN COALESCE(b365h <= 1 OR b365d <= 1 OR b365a <= 1, FALSE) THEN 'price_not_above_1' END], lambda x: x IS NOT NULL) AS violations
  FROM dirty) WHERE len(violations) > 0""")(
    lambda spark, sf: Q.contract_violations(dirty_contests(spark, sf)).select("match_id", "ftr", "fthg", "ftag", "violations"))


def _with_model_probability(df):
    """A probability column that breaks its range in some rows (derived from the price, for the contract's range rule)."""
    return df.withColumn("prob_home_win", F.when(F.col("match_id") % 31 == 0, F.lit(1.5)).otherwise(F.lit(1.0) / F.col("b365h")))


register("contract_valid", "P8", O.with_(O.DIRTY) + """
SELECT match_id, ftr, fthg, ftag FROM dirty
WHERE fthg >= 0 AND ftag >= 0 AND ftr IN ('H', 'D', 'A') AND NOT COALESCE(b365h <= 1 OR b365d <= 1 OR b365a <= 1, FALSE)
  AND match_id % 31 <> 0""")(
    lambda spark, sf: Q.contract_valid(_with_model_probability(dirty_contests(spark, sf))).select("match_id", "ftr", "fthg", "ftag"))

register("dq_report_missing_columns", "V1,V7", O.with_(O.DIRTY) + """
SELECT 'missing_column' AS "check", 'match_date' AS "column", CAST(1 AS BIGINT) AS n_bad, CAST(NULL AS VARCHAR) AS detail
UNION ALL SELECT 'missing_column', 'away_team', 1, NULL
UNION ALL SELECT 'null_values', 'home_team', COUNT(*) FILTER (WHERE home_team IS NULL), NULL FROM parsed
UNION ALL SELECT 'null_values', 'fthg', COUNT(*) FILTER (WHERE fthg IS NULL), NULL FROM parsed
UNION ALL SELECT 'null_values', 'ftag', COUNT(*) FILTER (WHERE ftag IS NULL), NULL FROM parsed
UNION ALL SELECT 'null_values', 'ftr', COUNT(*) FILTER (WHERE ftr IS NULL), NULL FROM parsed
UNION ALL SELECT 'invalid_result', 'ftr', COUNT(*) FILTER (WHERE ftr NOT IN ('H','D','A')), NULL FROM parsed
UNION ALL SELECT 'invalid_value', 'ftr', COUNT(*), ftr FROM parsed WHERE ftr NOT IN ('H','D','A') GROUP BY ftr
UNION ALL SELECT 'negative_goals', 'fthg', COUNT(*) FILTER (WHERE fthg < 0), NULL FROM parsed
UNION ALL SELECT 'negative_goals', 'ftag', COUNT(*) FILTER (WHERE ftag < 0), NULL FROM parsed""")(
    lambda spark, sf: Q.dq_report(_dirty_parsed(spark, sf).drop("match_date", "away_team")))


# ---------------------------------------------------------------- O5–O8, A13 splits
def _indexed(spark, sf):
    return SP.with_row_index(contests(spark, sf).select("match_id", "match_date"))


_IDX = O.with_(O.CONTESTS) + """, ix AS (SELECT match_id, match_date,
  row_number() OVER (ORDER BY match_date, match_id) - 1 AS idx, COUNT(*) OVER () AS n FROM c)"""

register("time_split", "O5", _IDX + """
SELECT match_id, match_date, idx, CASE WHEN idx < CAST(floor(n * 8e-1) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM ix""")(
    lambda spark, sf: SP.time_split(_indexed(spark, sf)))

register("calibration_split", "O6", _IDX + """
SELECT match_id, match_date, idx, CASE WHEN idx < CAST(floor(CAST(floor(n * 8e-1) AS BIGINT) * 8.75e-1) AS BIGINT) THEN 'fit'
  WHEN idx < CAST(floor(n * 8e-1) AS BIGINT) THEN 'calibration' ELSE 'test' END AS split FROM ix""")(
    lambda spark, sf: SP.calibration_split(_indexed(spark, sf)))

register("time_folds", "O7", _IDX + """, b AS (SELECT *, n // 6 AS size, n - 5 * (n // 6) AS first FROM ix)
SELECT match_id, match_date, idx, CAST(CASE WHEN idx < first THEN -1 ELSE (idx - first) // size END AS INTEGER) AS fold,
  first + CAST(CASE WHEN idx < first THEN -1 ELSE (idx - first) // size END AS INTEGER) * size AS fold_test_start FROM b""")(
    lambda spark, sf: SP.time_folds(_indexed(spark, sf)))

register("split_profile", "A13", _IDX + """, s AS (SELECT *, CASE WHEN idx < CAST(floor(n * 8e-1) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM ix)
SELECT split, COUNT(*) AS rows, min(match_date) AS first_date, max(match_date) AS last_date FROM s GROUP BY split""")(
    lambda spark, sf: SP.split_profile(SP.time_split(_indexed(spark, sf))))


# ---------------------------------------------------------------- S1–S7 season files, S4/J4 standings
from ..sources import seasons as SE  # noqa: E402
from ..session import fresh_path  # noqa: E402

_RAW_COLS = ["match_id", "div", "date_text", "home_team", "away_team", "fthg", "ftag", "ftr", "hs", "aws", "hst", "ast",
             "b365h", "b365d", "b365a", "season"]


def _raw_with_season(spark, sf):
    d = dirty_contests(spark, sf)
    from ..functions.calendar import season_label
    return d.withColumn("season", season_label("_true_date")).drop("_true_date")


def _scan(spark, sf):
    return SE.season_scan(spark, sf, _raw_with_season(spark, sf))


_OLD = "CAST(year(true_date) - CASE WHEN month(true_date) < 8 THEN 1 ELSE 0 END AS INTEGER) < 1998"
_SEASON_OF = ("CAST(year(true_date) - CASE WHEN month(true_date) < 8 THEN 1 ELSE 0 END AS VARCHAR) || '-' || "
              "lpad(CAST((year(true_date) - CASE WHEN month(true_date) < 8 THEN 1 ELSE 0 END + 1) % 100 AS VARCHAR), 2, '0')")
_SCAN_SQL = O.DIRTY.replace("hs, aws, hst, ast, b365h, b365d, b365a\n  FROM c0),",
                            "hs, aws, hst, ast, b365h, b365d, b365a, match_date AS true_date\n  FROM c0),")
_SCAN_SQL = O.with_(_SCAN_SQL) + f""",
scanned AS (
  SELECT match_id, div, date_text, home_team, away_team, CAST(fthg AS INTEGER) AS fthg, CAST(ftag AS INTEGER) AS ftag, ftr,
    CASE WHEN {_OLD} THEN NULL ELSE CAST(hs AS INTEGER) END AS hs, CASE WHEN {_OLD} THEN NULL ELSE CAST(aws AS INTEGER) END AS aws,
    CASE WHEN {_OLD} THEN NULL ELSE CAST(hst AS INTEGER) END AS hst, CASE WHEN {_OLD} THEN NULL ELSE CAST(ast AS INTEGER) END AS ast,
    CASE WHEN {_OLD} THEN NULL ELSE b365h END AS b365h, CASE WHEN {_OLD} THEN NULL ELSE b365d END AS b365d,
    CASE WHEN {_OLD} THEN NULL ELSE b365a END AS b365a, {_SEASON_OF} AS season
  FROM dirty)"""

register("season_scan", "S1,S2,S3,S6", _SCAN_SQL + " SELECT * FROM scanned")(
    lambda spark, sf: _scan(spark, sf).select(*_RAW_COLS))


def _ingest(spark, sf):
    """Files → clean → partitioned parquet table → read back."""
    cleaned = Q.clean_contests(_scan(spark, sf)).select(*_CLEAN_COLS)
    out = fresh_path(spark, "ingested")
    cleaned.write.partitionBy("season").parquet(out)
    return spark.read.parquet(out).select(*_CLEAN_COLS)


register("ingest_pipeline", "S5,S6,S7,P7", _SCAN_SQL.replace("FROM c0),\ndirty AS", "FROM c0),\ndirty AS", 1) + """,
p2 AS (SELECT *, CAST(CASE WHEN regexp_matches(date_text, '/[0-9][0-9]$') THEN try_strptime(date_text, '%d/%m/%y')
                      ELSE try_strptime(date_text, '%d/%m/%Y') END AS DATE) AS match_date FROM scanned)
SELECT match_id, div, trim(home_team, ' ') AS home_team, trim(away_team, ' ') AS away_team, fthg, ftag, ftr,
  COALESCE(hs, 0) AS hs, COALESCE(aws, 0) AS aws, COALESCE(hst, 0) AS hst, COALESCE(ast, 0) AS ast, b365h, b365d, b365a, match_date,
  make_date(CAST(year(match_date) - CASE WHEN month(match_date) < 8 THEN 1 ELSE 0 END AS INTEGER), 8, 1) AS season_start,
  CAST(year(match_date) - CASE WHEN month(match_date) < 8 THEN 1 ELSE 0 END AS VARCHAR) || '-' ||
    lpad(CAST((year(match_date) - CASE WHEN month(match_date) < 8 THEN 1 ELSE 0 END + 1) % 100 AS VARCHAR), 2, '0') AS season
FROM p2 WHERE ftr IN ('H','D','A') AND match_date IS NOT NULL AND home_team IS NOT NULL AND away_team IS NOT NULL
  AND fthg IS NOT NULL AND ftag IS NOT NULL""")(_ingest)

_FINAL_SQL = O.with_(O.CONTESTS) + """,
s AS (SELECT div, CAST(year(season_start) + 1 AS VARCHAR) AS season_end, home_team AS team, fthg AS gf, ftag AS ga,
        CASE ftr WHEN 'H' THEN 3 WHEN 'D' THEN 1 ELSE 0 END AS pts FROM c
      UNION ALL
      SELECT div, CAST(year(season_start) + 1 AS VARCHAR), away_team, ftag, fthg,
        CASE ftr WHEN 'A' THEN 3 WHEN 'D' THEN 1 ELSE 0 END FROM c),
t AS (SELECT div, season_end, team, SUM(pts) AS pts, SUM(gf - ga) AS gd, SUM(gf) AS gf FROM s GROUP BY ALL),
fin AS (SELECT div, team, season_end, CAST(row_number() OVER (PARTITION BY div, season_end
          ORDER BY pts DESC, gd DESC, gf DESC, team) AS INTEGER) AS position FROM t)"""

register("standings_long", "S4,D1", _FINAL_SQL + " SELECT div, team, season_end, position FROM fin")(
    lambda spark, sf: SE.standings_from_contests(spark, sf, contests(spark, sf)))


def _league_position(spark, sf):
    c = contests(spark, sf)
    st = SE.standings_from_contests(spark, sf, c)
    end = (F.year("season_start") + 1).cast("string")
    base = c.select("match_id", "div", "home_team", "away_team", end.alias("season_end"))
    h = st.select("div", F.col("team").alias("home_team"), "season_end", F.col("position").alias("home_position"))
    a = st.select("div", F.col("team").alias("away_team"), "season_end", F.col("position").alias("away_position"))
    return (base.join(h, ["div", "home_team", "season_end"], "left")
            .join(a, ["div", "away_team", "season_end"], "left")
            .select("match_id", "season_end", "home_position", "away_position"))


register("league_position", "J4", _FINAL_SQL + """
SELECT c.match_id, CAST(year(c.season_start) + 1 AS VARCHAR) AS season_end, h.position AS home_position,
  a.position AS away_position
FROM c LEFT JOIN fin h ON h.div = c.div AND h.team = c.home_team AND h.season_end = CAST(year(c.season_start) + 1 AS VARCHAR)
LEFT JOIN fin a ON a.div = c.div AND a.team = c.away_team AND a.season_end = CAST(year(c.season_start) + 1 AS VARCHAR)""")(
    _league_position)


# ---------------------------------------------------------------- W8, W9, T1–T5, A5, A6, O4, J5 (EDA)
from ..operators.league import live_positions  # noqa: E402
from . import eda as EDA  # noqa: E402

_EDA_BASE = """
rd AS (SELECT match_id, is_home, CAST(datediff('day', lag(match_date) OVER (PARTITION BY div, team ORDER BY match_date, match_id),
          match_date) AS INTEGER) AS rest FROM tl),
rest AS (SELECT match_id, max(CASE WHEN is_home THEN rest END) AS home_rest_days,
           max(CASE WHEN NOT is_home THEN rest END) AS away_rest_days FROM rd GROUP BY match_id),
rest2 AS (SELECT *, home_rest_days - away_rest_days AS rest_diff FROM rest),
sq AS (SELECT *, row_number() OVER (PARTITION BY div, season ORDER BY match_date, match_id) AS seq FROM c),
ev AS (SELECT div, season, seq, home_team AS team, 0 AS side, fthg AS gf, fthg - ftag AS gd,
         CASE ftr WHEN 'H' THEN 3 WHEN 'D' THEN 1 ELSE 0 END AS pts FROM sq
       UNION ALL SELECT div, season, seq, away_team, 1, ftag, ftag - fthg, CASE ftr WHEN 'A' THEN 3 WHEN 'D' THEN 1 ELSE 0 END FROM sq),
cum AS (SELECT div, season, team, seq, SUM(pts) OVER w AS pts, SUM(gd) OVER w AS gd, SUM(gf) OVER w AS gf FROM ev
        WINDOW w AS (PARTITION BY div, season, team ORDER BY seq ROWS UNBOUNDED PRECEDING)),
fs AS (SELECT div, season, team, min(seq * 2 + side) AS fs FROM ev GROUP BY ALL),
grid AS (SELECT m.div, m.season, m.seq, m.match_id, f.team, f.fs FROM sq m JOIN fs f
         ON f.div = m.div AND f.season = m.season AND f.fs < m.seq * 2),
st AS (SELECT g.*, k.pts, k.gd, k.gf FROM grid g ASOF JOIN cum k
       ON g.div = k.div AND g.season = k.season AND g.team = k.team AND g.seq > k.seq),
rk AS (SELECT match_id, team, COUNT(*) OVER (PARTITION BY match_id) AS nteams,
         row_number() OVER (PARTITION BY match_id ORDER BY pts DESC, gd DESC, gf DESC, fs) AS pos FROM st),
posn AS (SELECT m.match_id, CAST(CASE WHEN h.nteams >= 2 THEN h.pos END AS INTEGER) AS home_league_pos,
           CAST(CASE WHEN a.nteams >= 2 THEN a.pos END AS INTEGER) AS away_league_pos
         FROM sq m LEFT JOIN rk h ON h.match_id = m.match_id AND h.team = m.home_team
         LEFT JOIN rk a ON a.match_id = m.match_id AND a.team = m.away_team),
posn2 AS (SELECT *, home_league_pos - away_league_pos AS league_pos_diff FROM posn),
et AS (SELECT c.match_id, c.match_date, c.div, c.home_team, c.away_team, c.ftr,
         CASE c.ftr WHEN 'H' THEN 1 WHEN 'D' THEN 0 ELSE -1 END AS target_num, r.home_rest_days, r.away_rest_days,
         r.rest_diff, p.home_league_pos, p.away_league_pos, p.league_pos_diff
       FROM c JOIN rest2 r USING (match_id) JOIN posn2 p USING (match_id)),
rf AS (SELECT * FROM et WHERE home_rest_days IS NOT NULL AND away_rest_days IS NOT NULL),
pf AS (SELECT * FROM et WHERE home_league_pos IS NOT NULL AND away_league_pos IS NOT NULL)"""
_EDA = O.with_(O.CONTESTS, O.TEAM_LONG) + "," + _EDA_BASE


def _corr_sql(frame: str, cols: list[str], target: str = "target_num", extra: str = "") -> str:
    parts = []
    for c in cols:
        both = f"{c} IS NOT NULL AND {target} IS NOT NULL"
        parts.append(f"SELECT {extra}'{c}' AS feature, COUNT(*) FILTER (WHERE {both}) AS n, "
                     f"round(corr(CAST({c} AS DOUBLE), CAST({target} AS DOUBLE)) FILTER (WHERE {both}), 6) AS r FROM {frame}")
    return " UNION ALL ".join(parts)


def _anova_sql(frame: str, x: str) -> str:
    return f"""SELECT '{x}' AS feature, k - 1 AS df_between, N - k AS df_within,
  round(((br - S * S / N) / (k - 1)) / ((Q - br) / (N - k)), 6) AS f_stat FROM (
  SELECT CAST(SUM(n) AS BIGINT) AS N, SUM(s) AS S, COUNT(*) AS k, SUM(s * s / n) AS br, SUM(q) AS Q FROM (
    SELECT ftr, COUNT(*) AS n, SUM(CAST({x} AS DOUBLE)) AS s, SUM(CAST({x} AS DOUBLE) * CAST({x} AS DOUBLE)) AS q
    FROM {frame} WHERE {x} IS NOT NULL AND ftr IS NOT NULL GROUP BY ftr))"""


register("rest_days", "W8", _EDA + " SELECT match_id, home_rest_days, away_rest_days, rest_diff FROM rest2")(
    EDA.rest_days)
# running sums per team of the season's grid: equal joins only
_LIVE = O.with_(O.CONTESTS) + """,
sq AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY div, season ORDER BY match_date, match_id) AS seq FROM c),
ev AS MATERIALIZED (SELECT div, season, seq, home_team AS team, 0 AS side, fthg AS gf, fthg - ftag AS gd,
         CASE ftr WHEN 'H' THEN 3 WHEN 'D' THEN 1 ELSE 0 END AS pts FROM sq
       UNION ALL SELECT div, season, seq, away_team, 1, ftag, ftag - fthg, CASE ftr WHEN 'A' THEN 3 WHEN 'D' THEN 1 ELSE 0 END FROM sq),
fs AS MATERIALIZED (SELECT div, season, team, min(seq * 2 + side) AS fs FROM ev GROUP BY ALL),
grid AS MATERIALIZED (SELECT m.div, m.season, m.seq, f.team, f.fs FROM sq m JOIN fs f ON f.div = m.div AND f.season = m.season),
st AS MATERIALIZED (SELECT g.*, SUM(COALESCE(e.pts, 0)) OVER w AS pts, SUM(COALESCE(e.gd, 0)) OVER w AS gd, SUM(COALESCE(e.gf, 0)) OVER w AS gf
       FROM grid g LEFT JOIN ev e ON e.div = g.div AND e.season = g.season AND e.team = g.team AND e.seq = g.seq
       WINDOW w AS (PARTITION BY g.div, g.season, g.team ORDER BY g.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rk AS MATERIALIZED (SELECT div, season, seq, team, COUNT(*) OVER (PARTITION BY div, season, seq) AS nteams,
         row_number() OVER (PARTITION BY div, season, seq ORDER BY pts DESC, gd DESC, gf DESC, fs) AS pos FROM st WHERE fs < seq * 2)
SELECT m.match_id, CAST(CASE WHEN h.nteams >= 2 THEN h.pos END AS INTEGER) AS home_league_pos,
  CAST(CASE WHEN a.nteams >= 2 THEN a.pos END AS INTEGER) AS away_league_pos,
  CAST(CASE WHEN h.nteams >= 2 THEN h.pos END - CASE WHEN a.nteams >= 2 THEN a.pos END AS INTEGER) AS league_pos_diff
FROM sq m LEFT JOIN rk h ON h.div = m.div AND h.season = m.season AND h.seq = m.seq AND h.team = m.home_team
LEFT JOIN rk a ON a.div = m.div AND a.season = m.season AND a.seq = m.seq AND a.team = m.away_team"""
register("live_table", "W9", _LIVE)(
    lambda spark, sf: live_positions(contests(spark, sf)))
register("feature_corr", "T1", _EDA + " " + _corr_sql("rf", EDA.REST) + " UNION ALL " + _corr_sql("pf", EDA.POS))(
    EDA.new_feature_corr)
register("anova_outcome", "T3", _EDA + " " + _anova_sql("rf", "rest_diff") + " UNION ALL " + _anova_sql("pf", "league_pos_diff"))(
    EDA.anova_new)
register("corr_significance", "T2,T3")(EDA.significance)
register("outcome_summary", "A5", _EDA + """
SELECT ftr, 'rest_diff' AS feature, avg(rest_diff) AS mean, CAST(median(rest_diff) AS DOUBLE) AS median FROM rf
WHERE rest_diff IS NOT NULL GROUP BY ftr
UNION ALL SELECT ftr, 'league_pos_diff', avg(league_pos_diff), CAST(median(league_pos_diff) AS DOUBLE) FROM pf
WHERE league_pos_diff IS NOT NULL GROUP BY ftr""")(EDA.outcome_summary)
register("avg_position", "A6", _EDA + """
SELECT div, team, avg(pos) AS avg_position, COUNT(*) AS n FROM (
  SELECT div, home_team AS team, home_league_pos AS pos FROM pf UNION ALL SELECT div, away_team, away_league_pos FROM pf)
GROUP BY div, team""")(EDA.avg_position)

_MR_NUM = list(FE.MODEL_FEATURES)
_MR = _model_ready_sql().replace(" SELECT " + ", ".join(FE.META), ", mr AS (SELECT " + ", ".join(FE.META), 1) + \
    "), mrt AS (SELECT *, CASE target WHEN 'H' THEN 1 WHEN 'D' THEN 0 ELSE -1 END AS target_num FROM mr)"
register("feature_corr_all", "T4", _MR + " SELECT * FROM (" + _corr_sql("mrt", _MR_NUM) + ") WHERE r IS NOT NULL")(
    EDA.existing_corr)

_MR_EDA = _MR + "," + _EDA_BASE.replace("\nrd AS", "\nrd AS", 1)
register("corr_rank", "O4", _MR_EDA + """, allc AS (
  SELECT * FROM (""" + _corr_sql("mrt", _MR_NUM) + """) WHERE r IS NOT NULL
  UNION ALL SELECT * FROM (""" + _corr_sql("rf", ["rest_diff"]) + " UNION ALL " + _corr_sql("pf", ["league_pos_diff"]) + """))
SELECT CAST(rank AS INTEGER) AS rank, feature, r FROM (
  SELECT *, row_number() OVER (ORDER BY abs(r) DESC, feature) AS rank FROM allc WHERE r IS NOT NULL) WHERE rank <= 20""")(
    EDA.corr_rank)

register("collinearity", "T5,J5", _MR_EDA + """, merged AS (
  SELECT mrt.*, et.league_pos_diff, et.rest_diff FROM mrt JOIN et USING (match_id)
  WHERE et.league_pos_diff IS NOT NULL AND et.rest_diff IS NOT NULL)
""" + " UNION ALL ".join(
    _corr_sql("merged", EDA.CHECK_COLS, target=t, extra=f"'{t}' AS new_feature, ") for t in ("league_pos_diff", "rest_diff")))(
    EDA.collinearity)


# ---------------------------------------------------------------- A7–A12, F10–F12, R18 metrics and betting
from ..operators import metrics as MT  # noqa: E402
from . import training as TR  # noqa: E402


def _book(spark, sf):
    return contests(spark, sf).select("match_id", "match_date", F.col("ftr").alias("target"), "b365h",
                                      *P.implied_probabilities()).withColumn("pick", P.bookmaker_pick())


_BOOK = O.with_(O.CONTESTS) + ", i AS (SELECT match_id, match_date, ftr AS target, b365h, " + O.odds_cols() + """ FROM c),
b AS (SELECT *, CASE WHEN greatest(odds_prob_home, odds_prob_draw, odds_prob_away) IS NULL THEN NULL
  WHEN odds_prob_home = greatest(odds_prob_home, odds_prob_draw, odds_prob_away) THEN 'H'
  WHEN odds_prob_draw = greatest(odds_prob_home, odds_prob_draw, odds_prob_away) THEN 'D' ELSE 'A' END AS pick FROM i)"""

register("bookmaker_accuracy", "A11", _BOOK + """
SELECT avg(CAST(COALESCE(pick = target, FALSE) AS DOUBLE)) AS bookmaker_accuracy, COUNT(*) AS n FROM b""")(
    lambda spark, sf: MT.bookmaker_accuracy(_book(spark, sf)))

register("confusion", "A7", _BOOK + """
SELECT target AS actual, COUNT(*) FILTER (WHERE pick = 'A') AS A, COUNT(*) FILTER (WHERE pick = 'D') AS D,
  COUNT(*) FILTER (WHERE pick = 'H') AS H FROM b GROUP BY target""")(
    lambda spark, sf: MT.confusion(_book(spark, sf), pred="pick"))


def _class_report_sql() -> str:
    labels = MT.LABELS
    base = ", ".join([f"COUNT(*) FILTER (WHERE target = '{k}' AND pick = '{k}') AS tp_{k}, "
                      f"COUNT(*) FILTER (WHERE pick = '{k}') AS pp_{k}, COUNT(*) FILTER (WHERE target = '{k}') AS sup_{k}"
                      for k in labels])

    def prec(k):
        return f"(CASE WHEN pp_{k} > 0 THEN CAST(tp_{k} AS DOUBLE) / pp_{k} ELSE 0e0 END)"

    def rec(k):
        return f"(CASE WHEN sup_{k} > 0 THEN CAST(tp_{k} AS DOUBLE) / sup_{k} ELSE 0e0 END)"

    def f1(k):
        return f"(CASE WHEN {prec(k)} + {rec(k)} > 0 THEN 2e0 * {prec(k)} * {rec(k)} / ({prec(k)} + {rec(k)}) ELSE 0e0 END)"

    def mean(fn):
        e = "0e0"
        for k in labels:
            e = f"({e} + {fn(k)})"
        return f"({e} / 3e0)"

    def weighted(fn):
        e = "0e0"
        for k in labels:
            e = f"({e} + {fn(k)} * sup_{k})"
        return f"({e} / n)"

    rows = [f"SELECT '{k}' AS label, {prec(k)} AS precision, {rec(k)} AS recall, {f1(k)} AS f1, sup_{k} AS support FROM a"
            for k in labels]
    acc = "(CAST(hit AS DOUBLE) / n)"
    rows += [f"SELECT 'accuracy', {acc}, {acc}, {acc}, n FROM a",
             f"SELECT 'macro avg', {mean(prec)}, {mean(rec)}, {mean(f1)}, n FROM a",
             f"SELECT 'weighted avg', {weighted(prec)}, {weighted(rec)}, {weighted(f1)}, n FROM a"]
    return (_BOOK + f", a AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE target = pick) AS hit, {base} FROM b) "
            + " UNION ALL ".join(rows))


register("class_report", "A8,A9", _class_report_sql())(
    lambda spark, sf: MT.class_report(_book(spark, sf), pred="pick"))

register("log_loss", "A10", _BOOK + f"""
SELECT round(-avg(ln(least(greatest(p / tot, {O.dlit(MT.EPS)}), {O.dlit(1.0 - MT.EPS)}))), 9) AS log_loss, COUNT(*) AS n FROM (
  SELECT odds_prob_away + odds_prob_draw + odds_prob_home AS tot,
    CASE target WHEN 'A' THEN odds_prob_away WHEN 'D' THEN odds_prob_draw WHEN 'H' THEN odds_prob_home END AS p FROM b)
WHERE p IS NOT NULL AND least(greatest(p / tot, {O.dlit(MT.EPS)}), {O.dlit(1.0 - MT.EPS)}) IS NOT NULL""")(
    lambda spark, sf: MT.log_loss(_book(spark, sf).withColumnRenamed("odds_prob_away", "prob_A")
                                  .withColumnRenamed("odds_prob_draw", "prob_D").withColumnRenamed("odds_prob_home", "prob_H")))


def _value(spark, sf):
    """Elo expected home score as the model probability vs the bookmaker's home probability."""
    c = contests(spark, sf)
    e = elo_history(c).select("match_id", "home_elo", "away_elo")
    x = c.select("match_id", "match_date", "ftr", "b365h", *P.implied_probabilities()).join(e, "match_id")
    p_model = F.lit(1.0) / (F.lit(1.0) + F.pow(F.lit(10.0), (F.col("away_elo") - F.col("home_elo") - F.lit(100.0)) / F.lit(400.0)))
    return (x.withColumn("model_prob_home", p_model)
            .withColumn("edge", P.value_edge("model_prob_home", "odds_prob_home"))
            .withColumn("is_value", P.is_value_bet("model_prob_home", "odds_prob_home")))


_VALUE = "WITH RECURSIVE " + O.CONTESTS + "," + O.ELO + ", i AS (SELECT match_id, match_date, ftr, b365h, " + O.odds_cols() + \
    """ FROM c), v AS (SELECT i.*, 1e0 / (1e0 + pow(1e1, (e.away_elo - e.home_elo - 1e2) / 4e2)) AS model_prob_home
    FROM i JOIN elo e USING (match_id)), vv AS (SELECT *, COALESCE(model_prob_home - odds_prob_home, 0e0) AS edge,
    COALESCE(model_prob_home - odds_prob_home, 0e0) > 0e0 AS is_value FROM v)"""

register("value_bets", "F10,F11", _VALUE + " SELECT match_id, round(model_prob_home, 9) AS model_prob_home, round(edge, 9) AS edge, is_value FROM vv")(
    lambda spark, sf: _value(spark, sf).select("match_id", F.round("model_prob_home", 9).alias("model_prob_home"),
                                               F.round("edge", 9).alias("edge"), "is_value"))


def _bet_profit(spark, sf):
    """Stake 1 on every home value bet; daily profit/loss and its running total."""
    v = _value(spark, sf).where("is_value")
    pnl = F.when(F.col("ftr") == "H", F.col("b365h") - 1.0).otherwise(F.lit(-1.0))
    daily = v.groupBy("match_date").agg(F.count(F.lit(1)).alias("bets"), F.round(F.sum(pnl), 6).alias("pnl"))
    from pyspark.sql import Window as W  # one row per day: bounded by the calendar, not the data
    return daily.withColumn("cum_pnl", F.round(F.sum("pnl").over(W.orderBy("match_date")
                                                                 .rowsBetween(W.unboundedPreceding, 0)), 6))


register("bet_profit", "R18,F11", _VALUE + """, d AS (SELECT match_date, COUNT(*) AS bets,
  round(SUM(CASE WHEN ftr = 'H' THEN b365h - 1e0 ELSE -1e0 END), 6) AS pnl FROM vv WHERE is_value GROUP BY match_date)
SELECT match_date, bets, pnl, round(SUM(pnl) OVER (ORDER BY match_date ROWS UNBOUNDED PRECEDING), 6) AS cum_pnl FROM d""")(
    _bet_profit)


def _confidence(spark, sf):
    """F12 with the home side's rest days and head-to-head count: one team-window pass."""
    side = (FE.side_features(spark, sf, ["h2h", "rest"]).where(F.col("is_home"))
            .select("match_id", "h2h_played", F.col("rest_days").alias("home_rest_days")))
    odds = contests(spark, sf).select("match_id", *P.implied_probabilities()[:3])
    x = side.join(odds, "match_id")
    pmax = F.greatest("odds_prob_home", "odds_prob_draw", "odds_prob_away")
    return x.select("match_id", F.round(P.confidence(pmax, F.coalesce("home_rest_days", F.lit(0)), "h2h_played"), 9)
                    .alias("confidence"))


register("confidence", "F12", B1_SQL + "," + _EDA_BASE + """
SELECT f.match_id, round(least(greatest(greatest(f.odds_prob_home, f.odds_prob_draw, f.odds_prob_away)
  - least(COALESCE(r.home_rest_days, 0) / 365e0, 2e-1) + least(f.h2h_played * 1e-2, 5e-2), 0e0), 1e0), 9) AS confidence
FROM feat f JOIN rest2 r USING (match_id)""")(_confidence)


# ---------------------------------------------------------------- M1–M13, B4, B5, O3 (models: no SQL oracle)
def _data(spark, sf):
    """Model-ready rows with split and label, written once: every fit and evaluation reads them again."""
    return materialize(TR.prepare(FE.model_ready(FE.match_features(spark, sf))), "model-rows")


def _train_models(spark, sf):
    """M8 leaderboard of all models."""
    d = _data(spark, sf)
    return TR.leaderboard(spark, d, TR.train_models(d))


register("train_models", "M1,M2,M3,M4,M5,M6,M7,M8,M12,A12,O8,O10")(_train_models)


def _train_one(name: str):
    def run(spark, sf):
        d = _data(spark, sf)
        return TR.leaderboard(spark, d, TR.train_models(d, (name,)))
    return run


register("train_boosting", "M5,M7")(_train_one("Gradient Boosting"))
register("train_second_order", "M6,M7")(_train_one("Second-order Boosting"))


def _importance(spark, sf):
    d = _data(spark, sf)
    cols = TR.usable_features(d, TR.feature_columns(d))
    return TR.feature_importance(spark, TR.fit_forest(d.where(F.col("split") == "fit"), cols))


register("feature_importance", "O3,M4")(_importance)


def _calibrated_logistic(spark, sf):
    d = _data(spark, sf)
    cols = TR.usable_features(d, TR.feature_columns(d))
    t = TR.fit_logistic(d.where(F.col("split") == "fit"), cols)
    return d, TR.calibrate(t, d.where(F.col("split") == "calibration"))


register("test_predictions", "B5,M7,F13")(lambda spark, sf: TR.test_predictions(*reversed(_calibrated_logistic(spark, sf))))


def _cv(spark, sf):
    res = TR.cv_scores(_data(spark, sf))
    return spark.createDataFrame([(r["model"], r["mean_accuracy"], r["std_accuracy"], r["folds"]) for r in res],
                                 "model string, mean_accuracy double, std_accuracy double, folds array<double>")


register("cv_scores", "M9,O7")(_cv)


# ---------------------------------------------------------------- J6, B3, B4, M11, M13 serving
from . import scoring as SC  # noqa: E402


def _rejects(spark, sf):
    hist, fx = SC.split_history(spark, sf)
    return SC.check_fixtures(SC.with_hard_cases(fx), hist)[1]


def _accepted(spark, sf):
    hist, fx = SC.split_history(spark, sf)
    return SC.check_fixtures(SC.with_hard_cases(fx), hist)[0].select("match_id", "div", "home_team", "away_team")


_FX = O.with_(O.CONTESTS) + """, cut AS (SELECT max(match_date) - INTERVAL 30 DAY AS d FROM c),
hist AS (SELECT * FROM c WHERE match_date <= (SELECT CAST(d AS DATE) FROM cut)),
fx0 AS (SELECT * FROM c WHERE match_date > (SELECT CAST(d AS DATE) FROM cut)),
fx AS (SELECT * REPLACE (CASE WHEN match_id % 11 = 0 THEN 'X' || home_team ELSE home_team END AS home_team,
  CASE WHEN match_id % 13 = 0 THEN CASE WHEN match_id % 11 = 0 THEN 'X' || home_team ELSE home_team END
       WHEN match_id % 7 = 0 THEN 'Y' || away_team ELSE away_team END AS away_team) FROM fx0),
known AS (SELECT DISTINCT div, home_team AS team FROM hist UNION SELECT DISTINCT div, away_team FROM hist)"""

register("fixture_reject", "J6,D8", _FX + """
SELECT match_id, 'unknown_home' AS reason FROM fx WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.div = fx.div AND k.team = fx.home_team)
UNION ALL SELECT match_id, 'unknown_away' FROM fx WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.div = fx.div AND k.team = fx.away_team)
UNION ALL SELECT match_id, 'same_team' FROM fx WHERE home_team = away_team""")(_rejects)

register("fixture_accept", "J6", _FX + """
SELECT match_id, div, home_team, away_team FROM fx
WHERE EXISTS (SELECT 1 FROM known k WHERE k.div = fx.div AND k.team = fx.home_team)
  AND EXISTS (SELECT 1 FROM known k WHERE k.div = fx.div AND k.team = fx.away_team) AND home_team <> away_team""")(_accepted)

register("batch_predict", "B3,B4,M13,F8,F9,F12,F13")(SC.batch_predict)


def _compare_versions(spark, sf):
    """Append-only run-metrics table of all model versions, compared side by side; the differences are
    taken from the logistic version."""
    d = _data(spark, sf)
    board = TR.leaderboard(spark, d, TR.train_models(d))
    long = board.select(F.col("model").alias("version"), F.explode(F.create_map(
        *[x for m in ("train_accuracy", "test_accuracy", "test_f1_macro", "test_log_loss")
          for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "value"))
    path = fresh_path(spark, "run-metrics")
    long.write.mode("append").parquet(path)
    runs = spark.read.parquet(path)
    return (runs.groupBy("metric").pivot("version").agg(F.first("value"))
            .withColumns({f"difference_{short}": F.col(f"`{name}`") - F.col("`Logistic Regression`") for short, name in (
                ("forest", "Random Forest"), ("boosting", "Gradient Boosting"), ("second_order", "Second-order Boosting"))}))


register("compare_versions", "M11")(_compare_versions)


# ---------------------------------------------------------------- R1–R5 streams, R11, R12, R16, R17
from ..streaming import jobs as SJ  # noqa: E402
from ..streaming import run as SR  # noqa: E402
from . import monitoring as MO  # noqa: E402

register("sliding_avg", "R1", """
SELECT window_start, window_end, event_type, sum_value, n, sum_value / n AS avg_value FROM (
SELECT ws AS window_start, ws + INTERVAL 1 HOUR AS window_end, event_type, round(sum(value), 9) AS sum_value, COUNT(value) AS n
FROM (SELECT event_type, value, time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL (k * 10) MINUTE AS ws
      FROM events, range(6) t(k)) GROUP BY ALL)""")(lambda spark, sf: SJ.sliding_averages(SR.events(spark, sf)))

register("route_events", "R2", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type")(SR.routed_counts)

register("value_moves", "R3", """
SELECT event_id, ts, user_id, event_type, prev_value, value, round(rel, 9) AS rel_change FROM (
  SELECT *, CASE WHEN prev_value <> 0 THEN (value - prev_value) / abs(prev_value) END AS rel FROM (
    SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prev_value FROM events))
WHERE abs(rel) > 2e-1""")(lambda spark, sf: SJ.value_moves(SR.events(spark, sf)))

register("elo_stream", "R4", "WITH RECURSIVE " + O.CONTESTS + "," + O.ELO + """
SELECT e.match_id, c.div, e.home_elo, e.away_elo, e.home_elo_post, e.away_elo_post FROM elo e JOIN c USING (match_id)""")(
    SR.elo_stream_history)

register("rolling_48h", "R5", """
SELECT *, sum_48h / n_48h AS avg_48h FROM (
SELECT event_id, ts, event_type, round(sum(value) OVER w, 9) AS sum_48h, COUNT(value) OVER w AS n_48h FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 172800 PRECEDING AND CURRENT ROW))""")(
    lambda spark, sf: SJ.rolling_48h(SR.events(spark, sf)))

register("psi_drift", "R11", O.with_(O.CONTESTS) + ", i AS (SELECT season, " + O.odds_cols() + """ FROM c),
j AS (SELECT season, CAST(least(floor(odds_prob_home * 10), 9) AS INTEGER) AS bucket FROM i WHERE odds_prob_home IS NOT NULL),
tot AS (SELECT season, COUNT(*) AS total FROM j GROUP BY season),
grid AS (SELECT season, total, b AS bucket FROM tot, range(10) r(b)),
cnt AS (SELECT season, bucket, COUNT(*) AS n FROM j GROUP BY ALL),
sh AS (SELECT g.season, g.bucket, greatest(CAST(COALESCE(cnt.n, 0) AS DOUBLE) / g.total, 1e-4) AS share
       FROM grid g LEFT JOIN cnt ON cnt.season = g.season AND cnt.bucket = g.bucket),
t AS (SELECT *, lag(share) OVER (PARTITION BY bucket ORDER BY season) AS prev FROM sh)
SELECT season, round(SUM((share - prev) * ln(share / prev)), 9) AS psi FROM t WHERE prev IS NOT NULL GROUP BY season""")(
    MO.psi_drift)

register("accuracy_by_month", "R12", _BOOK.replace("SELECT match_id, match_date, ftr AS target", "SELECT match_id, match_date, ftr AS target", 1) + """,
m AS (SELECT date_trunc('month', match_date) AS month, COUNT(*) AS n,
        COUNT(*) FILTER (WHERE COALESCE(pick = target, FALSE)) AS hits FROM b GROUP BY 1)
SELECT CAST(month AS DATE) AS month, n, CAST(hits AS DOUBLE) / n AS accuracy,
  CAST(SUM(hits) OVER w AS DOUBLE) / SUM(n) OVER w AS accuracy_3m FROM m
WINDOW w AS (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")(MO.accuracy_by_month)

register("auc_ovr", "R17", O.with_(O.CONTESTS) + ", i AS (SELECT ftr, " + O.odds_cols() + """ FROM c WHERE b365h IS NOT NULL),
l AS (SELECT ftr, 'A' AS cls, odds_prob_away AS score FROM i UNION ALL SELECT ftr, 'D', odds_prob_draw FROM i
      UNION ALL SELECT ftr, 'H', odds_prob_home FROM i),
g AS (SELECT cls, score, COUNT(*) AS cnt, COUNT(*) FILTER (WHERE ftr = cls) AS pos FROM l GROUP BY ALL),
r AS (SELECT *, COALESCE(SUM(cnt) OVER (PARTITION BY cls ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        + (cnt + 1e0) / 2e0 AS avg_rank FROM g),
a AS (SELECT cls, SUM(pos * avg_rank) AS rank_sum, CAST(SUM(pos) AS BIGINT) AS n_pos, CAST(SUM(cnt) AS BIGINT) AS n FROM r GROUP BY cls)
SELECT cls, n_pos, n - n_pos AS n_neg, round((rank_sum - n_pos * (n_pos + 1) / 2e0) / (n_pos * (n - n_pos)), 12) AS auc FROM a""")(
    MO.auc_ovr)

register("goals_model", "R16")(MO.goals_model)


# ---------------------------------------------------------------- J1/R14 point-in-time state of entities
from ..operators.asof import asof_features  # noqa: E402

_ASOF_COLS = ["form5_points", "form5_win_rate", "form10_goal_diff", "exp_form", "avg_shots", "shot_accuracy",
              "win_streak", "unbeaten_streak", "loss_streak", "season_played", "season_win_rate", "season_ppg",
              "venue_win_rate", "venue_clean_sheets", "h2h_played", "h2h_win_rate", "h2h_avg_gf"]


def _asof_state(spark, sf):
    """As-of state of both sides of the last 30 days' contests from the whole history (the
    serving path); by construction it must equal the training features of those contests."""
    c = contests(spark, sf)
    _, fx = SC.split_history(spark, sf)
    return asof_features(c, fx).select("match_id", "team", "is_home", *_ASOF_COLS)


register("asof_state", "J1,R14,B3", "WITH " + O.side_all() + """,
cut AS (SELECT CAST(max(match_date) - INTERVAL 30 DAY AS DATE) AS d FROM c)
SELECT match_id, team, is_home, """ + ", ".join(_ASOF_COLS) + """ FROM sides
WHERE match_id IN (SELECT match_id FROM c WHERE match_date > (SELECT d FROM cut))""")(_asof_state)
