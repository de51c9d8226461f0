"""The per-contest feature table and the model-ready table.

Plan shape (see README "Plans"):

    orders scan → contests (narrow) → team-long (explode) ─┐
        └ [blocked halo side tables, only when the data needs several blocks]
    ─→ Exchange hash(div, team, _blk) → windows (form, exp, venue, season, shooting, streaks, h2h)
    ─→ Exchange hash(match_id) → U3 pivot back to one row per contest (home_*/away_*)
    ─→ join Elo (its own Exchange hash(div) → sort → ordered fold) on match_id

Match-level columns (prices, goals, result) ride on the home row through the team shuffle,
so no second scan/shuffle of the contest table is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import temporal_columns
from ..functions.keys import match_key
from ..functions.prices import implied_probabilities
from ..operators.blocked import block_width
from ..operators.elo import elo_history
from ..operators.medians import exact_medians
from ..operators.perspective import team_long
from ..operators.team_windows import FORM_WINDOWS, GROUPS, KEY, TARGET_ROWS, team_features
from ..session import materialize
from ..sources.contests import contests

META = ["match_id", "match_date", "div", "home_team", "away_team", "season"]
TARGETS = ["target", "home_goals", "away_goals"]

SIDE_FEATURES = (
    [f"form{n}_{m}" for n in FORM_WINDOWS
     for m in ("points", "win_rate", "goal_diff", "avg_goals_for", "avg_goals_against")]
    + ["exp_form", "venue_win_rate", "venue_avg_goals_for", "venue_avg_goals_against", "venue_clean_sheets",
       "season_played", "season_win_rate", "season_ppg", "season_avg_goals_for", "season_avg_goals_against",
       "season_clean_sheets", "win_streak", "unbeaten_streak", "loss_streak",
       "avg_shots", "avg_sot", "shot_accuracy", "shot_conversion"])
H2H = ["h2h_played", "h2h_win_rate", "h2h_avg_gf"]
ODDS = ["odds_prob_home", "odds_prob_draw", "odds_prob_away", "odds_home_away_diff", "odds_fav_is_home"]
TEMPORAL = ["day_of_week", "month", "is_weekend", "matchweek"]
ELO = ["home_elo", "away_elo", "elo_diff"]

# The reference's ordered list of the 59 model features.
MODEL_FEATURES = [
    "home_elo", "away_elo", "elo_diff",
    "odds_prob_home", "odds_prob_draw", "odds_prob_away", "odds_home_away_diff", "odds_fav_is_home",
    "home_form5_points", "home_form5_win_rate", "home_form5_goal_diff",
    "away_form5_points", "away_form5_win_rate", "away_form5_goal_diff",
    "home_form3_win_rate", "home_form3_goal_diff", "away_form3_win_rate", "away_form3_goal_diff",
    "home_exp_form", "away_exp_form",
    "home_venue_win_rate", "home_venue_avg_goals_for", "home_venue_clean_sheets",
    "away_venue_win_rate", "away_venue_avg_goals_for", "away_venue_clean_sheets",
    "home_season_win_rate", "home_season_ppg", "home_season_avg_goals_for", "home_season_clean_sheets",
    "away_season_win_rate", "away_season_ppg", "away_season_avg_goals_for", "away_season_clean_sheets",
    "home_win_streak", "home_unbeaten_streak", "away_win_streak", "away_unbeaten_streak",
    "home_shot_accuracy", "home_shot_conversion", "away_shot_accuracy", "away_shot_conversion",
    "h2h_win_rate", "h2h_avg_gf",
    "diff_form5_points", "diff_form5_goal_diff", "diff_form5_win_rate",
    "diff_season_win_rate", "diff_season_ppg", "diff_season_goals_for",
    "diff_venue_win_rate", "diff_venue_goals",
    "home_attack_vs_away_defense", "away_attack_vs_home_defense",
    "diff_exp_form", "diff_win_streak",
    "is_weekend", "month", "matchweek",
]
CORE = ["home_form5_points", "away_form5_points", "home_season_win_rate"]

# Fixed values: (output, home-side minuend, away-side subtrahend) of the 12 difference features (F2)
DIFFS = [
    ("diff_form5_points", "home_form5_points", "away_form5_points"),
    ("diff_form5_goal_diff", "home_form5_goal_diff", "away_form5_goal_diff"),
    ("diff_form5_win_rate", "home_form5_win_rate", "away_form5_win_rate"),
    ("diff_season_win_rate", "home_season_win_rate", "away_season_win_rate"),
    ("diff_season_ppg", "home_season_ppg", "away_season_ppg"),
    ("diff_season_goals_for", "home_season_avg_goals_for", "away_season_avg_goals_for"),
    ("diff_venue_win_rate", "home_venue_win_rate", "away_venue_win_rate"),
    ("diff_venue_goals", "home_venue_avg_goals_for", "away_venue_avg_goals_for"),
    ("home_attack_vs_away_defense", "home_season_avg_goals_for", "away_season_avg_goals_against"),
    ("away_attack_vs_home_defense", "away_season_avg_goals_for", "home_season_avg_goals_against"),
    ("diff_exp_form", "home_exp_form", "away_exp_form"),
    ("diff_win_streak", "home_win_streak", "away_win_streak"),
]


def side_features(spark: SparkSession, sf_dir: str, groups=GROUPS, width: int | None = None,
                  carry: bool = False) -> DataFrame:
    """Point-in-time features per team-long row (one row per contest side)."""
    c = contests(spark, sf_dir)
    tl = team_long(c, carry=["b365h", "b365d", "b365a", "fthg", "ftag", "ftr"] if carry else None)
    if width is None:
        width = block_width(tl, KEY, target_rows=TARGET_ROWS)
    return team_features(tl, width, groups)


def diff_columns() -> list:
    """all twelve are null when either side lacks ``form5_points``."""
    ok = F.col("home_form5_points").isNotNull() & F.col("away_form5_points").isNotNull()
    return [F.when(ok, F.col(h) - F.col(a)).alias(n) for n, h, a in DIFFS]


def match_features(spark: SparkSession, sf_dir: str, width: int | None = None,
                   with_elo: bool = True) -> DataFrame:
    """B1: every feature for every played contest, plus ``target, home_goals, away_goals``.

    U3 pairs the two sides of a contest by one exchange and one sort on ``match_id``: in a window over the
    contest the away row comes first and ``lead`` hands it the home row's columns, so no wide row is aggregated. Each
    column has a ``lead`` of its own: one that the caller does not select is neither computed nor shuffled. The
    payload (prices, goals, result) and the Elo rows join on the same partitioning and order; they never
    travel through the team windows.
    """
    tf = side_features(spark, sf_dir, GROUPS, width)
    pair = Window.partitionBy("match_id").orderBy("is_home")
    sides = (tf.select("match_id", "is_home", *SIDE_FEATURES,
                       *[F.lead(c).over(pair).alias("h_" + c) for c in ("match_date", "div", "team", "opponent", "season", *SIDE_FEATURES, *H2H)])
             .where(~F.col("is_home")))
    c = contests(spark, sf_dir)
    joined = sides.join(c.select("match_id", "b365h", "b365d", "b365a", "fthg", "ftag", "ftr"), "match_id")
    if with_elo:
        joined = joined.join(elo_history(c).select("match_id", "home_elo", "away_elo"), "match_id")
    wide = joined.select(
        "match_id", F.col("h_match_date").alias("match_date"), F.col("h_div").alias("div"), F.col("h_team").alias("home_team"),
        F.col("h_opponent").alias("away_team"), F.col("h_season").alias("season"),
        *[F.col("h_" + x).alias("home_" + x) for x in SIDE_FEATURES],
        *[F.col(x).alias("away_" + x) for x in SIDE_FEATURES], *[F.col("h_" + x).alias(x) for x in H2H],
        *implied_probabilities("b365h", "b365d", "b365a"),
        F.col("ftr").alias("target"), F.col("fthg").alias("home_goals"), F.col("ftag").alias("away_goals"),
        *(["home_elo", "away_elo", (F.col("home_elo") - F.col("away_elo")).alias("elo_diff")] if with_elo else []))
    return wide.select("*", *diff_columns(), *temporal_columns("match_date"),
                       match_key("home_team", "away_team", "match_date").alias("match_key"))


def model_ready(features: DataFrame, medians: dict | None = None, leaky: bool = False,
                test_size: float = 0.2, wanted: list[str] | None = None) -> DataFrame:
    """B2: drop rows missing a core feature, fill other nulls with exact medians, keep meta +
    the 59 features + targets.

    Medians come from the training part only — the first ``int(n·(1−test_size))`` clean rows in
    (date, id) order — so test rows never inform the fill (D3). ``leaky=True`` reproduces the
    reference, which took the medians of all clean rows. Columns that are null everywhere stay
    null (no median exists). ``wanted``: the model features that the caller reads (default: all);
    the rows and the values of the others do not depend on it.
    """
    avail = [c for c in MODEL_FEATURES if c in features.columns and (wanted is None or c in wanted)]
    clean = features.na.drop(subset=CORE).select(*META, *avail, *TARGETS)
    if medians is None:
        clean = materialize(clean, "model-ready-clean")  # scanned several times below: cut the lineage once
    if medians is None:
        base = clean
        if not leaky:
            from ..operators.splits import first_after

            thr = first_after(clean, test_size)
            if thr is not None:  # the first test row's (date, id): training rows are exactly the ones ordered before it
                base = clean.where((F.col("match_date") < F.lit(thr["match_date"]))
                                   | ((F.col("match_date") == F.lit(thr["match_date"]))
                                      & (F.col("match_id") < F.lit(thr["match_id"]))))
        medians = exact_medians(base, avail)
    fills = {c: v for c, v in medians.items() if v is not None and c in avail}
    out = clean.select(*META, *[F.coalesce(F.col(c), F.lit(fills[c])).cast("double").alias(c) if c in fills
                                else F.col(c).cast("double").alias(c) for c in avail], *TARGETS)
    return out
