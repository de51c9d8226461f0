"""Point-in-time state of arbitrary entities ``(div, team, date)`` — e.g. fixtures
that are not in the history — from the played history, strictly before the entity's date.

1. ``team_features(..., inclusive=True)`` gives the state *after* every played row (same
   time-blocked windows as training, so hot teams are split across tasks);
2. each stream's states are reduced to the last state of each ``(key, day)`` (partial
   ``max_by`` map-side: at most one row per key and day survives, however hot the key);
3. probes are unioned in, sorting before same-day states, and
   ``last(state, ignorenulls)`` over the preceding rows picks the state as of the day before.

The season rule is applied at the probe's date: season sums count only when the state's
season is the probe's season; otherwise the last-10 fallback applies. Fed the contests of the
history itself, the result equals the training features (parity).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import season_start
from .blocked import block_width
from .perspective import team_long
from .team_windows import FORM_WINDOWS, KEY, SEASON_MIN_PLAYED, TARGET_ROWS, team_features

TEAM_STATE = ([f"form{n}_{m}" for n in FORM_WINDOWS
               for m in ("points", "win_rate", "goal_diff", "avg_goals_for", "avg_goals_against")]
              + ["exp_form", "avg_shots", "avg_sot", "shot_accuracy", "shot_conversion",
                 "win_streak", "unbeaten_streak", "loss_streak"]
              + [f"sn_{m}" for m in ("n", "win", "pts", "gf", "ga", "cs")]
              + [f"fb_{m}" for m in ("n", "win", "pts", "gf", "ga", "cs")])
VENUE_STATE = ["venue_win_rate", "venue_avg_goals_for", "venue_avg_goals_against", "venue_clean_sheets"]
H2H_STATE = ["h2h_played", "h2h_win_rate", "h2h_avg_gf"]


def probe_sides(fixtures: DataFrame) -> DataFrame:
    """Two probes per fixture: ``(match_id, div, team, opponent, is_home, match_date, season_start)``."""
    s = F.explode(F.array(
        F.struct(F.col("home_team").alias("team"), F.col("away_team").alias("opponent"), F.lit(True).alias("is_home")),
        F.struct(F.col("away_team").alias("team"), F.col("home_team").alias("opponent"), F.lit(False).alias("is_home"))))
    return (fixtures.select("match_id", "div", "match_date", season_start("match_date").alias("season_start"), s.alias("s"))
            .select("match_id", "div", "s.team", "s.opponent", "s.is_home", "match_date", "season_start"))


def _asof(states: DataFrame, probes: DataFrame, key: list[str], cols: list[str]) -> DataFrame:
    st = F.struct(*[F.col(c) for c in cols], F.col("match_date").alias("state_date"),
                  F.col("season_start").alias("state_season"))
    daily = (states.groupBy(*key, "match_date").agg(F.max_by(st, F.col("match_id")).alias("_st"))
             .select(*key, "match_date", F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_pid"),
                     F.lit(None).cast("boolean").alias("_ph"), "_st"))
    pr = probes.select(*key, "match_date", F.lit(0).alias("_kind"), F.col("match_id").alias("_pid"),
                       F.col("is_home").alias("_ph"), F.lit(None).cast(daily.schema["_st"].dataType).alias("_st"))
    w = Window.partitionBy(*key).orderBy("match_date", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    both = daily.unionByName(pr).withColumn("_asof", F.last("_st", ignorenulls=True).over(w))
    return both.where(F.col("_kind") == 0).select(F.col("_pid").alias("match_id"), F.col("_ph").alias("is_home"), "_asof")


def asof_features(history: DataFrame, fixtures: DataFrame, width: int | None = None) -> DataFrame:
    """Features of every fixture side as of its date (strictly earlier history rows only)."""
    tl = team_long(history)
    if width is None:
        width = block_width(tl, KEY, target_rows=TARGET_ROWS)
    states = team_features(tl, width, ["form", "exp", "streaks", "season", "shooting", "venue", "h2h"], inclusive=True)
    probes = probe_sides(fixtures)
    t = _asof(states, probes, KEY, TEAM_STATE).withColumnRenamed("_asof", "t")
    v = _asof(states, probes, KEY + ["is_home"], VENUE_STATE).withColumnRenamed("_asof", "v")
    h = _asof(states, probes, KEY + ["opponent"], H2H_STATE).withColumnRenamed("_asof", "h")
    x = (probes.join(t, ["match_id", "is_home"], "left").join(v, ["match_id", "is_home"], "left")
         .join(h, ["match_id", "is_home"], "left"))
    same = F.col("t.state_season") == F.col("season_start")
    s_n = F.when(same, F.col("t.sn_n")).otherwise(F.lit(0))
    use = s_n >= SEASON_MIN_PLAYED

    def ratio(num, den):
        return F.when(den > 0, num.cast("double") / den)

    def pick(m):
        return F.when(use, ratio(F.col(f"t.sn_{m}"), s_n)).otherwise(ratio(F.col(f"t.fb_{m}"), F.col("t.fb_n")))

    return x.select(
        "match_id", "div", "team", "opponent", "is_home", "match_date",
        *[F.col("t." + c).alias(c) for c in TEAM_STATE if not (c.startswith("sn_") or c.startswith("fb_"))
          and "streak" not in c],
        *[F.coalesce(F.col("t." + c), F.lit(0)).cast("long").alias(c) for c in ("win_streak", "unbeaten_streak", "loss_streak")],
        F.coalesce(F.when(use, s_n).otherwise(F.col("t.fb_n")), F.lit(0)).cast("long").alias("season_played"),
        pick("win").alias("season_win_rate"), pick("pts").alias("season_ppg"), pick("gf").alias("season_avg_goals_for"),
        pick("ga").alias("season_avg_goals_against"), pick("cs").alias("season_clean_sheets"),
        *[F.col("v." + c).alias(c) for c in VENUE_STATE],
        F.coalesce(F.col("h.h2h_played"), F.lit(0)).cast("long").alias("h2h_played"),
        F.col("h.h2h_win_rate").alias("h2h_win_rate"), F.col("h.h2h_avg_gf").alias("h2h_avg_gf"),
        F.datediff("match_date", F.col("t.state_date")).alias("rest_days"))
