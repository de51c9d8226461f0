"""History queries over the contest table.

All are computed for every team / pair at once (no per-team driver loop). Aggregations use
map-side partial aggregation, so a hot team is pre-aggregated before the shuffle; per-key
top-k uses ``row_number() <= k`` which Spark plans as a partial WindowGroupLimit (at most k
rows per key leave each map task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import pair_key
from .perspective import team_long

RECENT_DEFAULT = 10
LIMITS = (1, 50)  # fixed values: the bounds of the limit argument
FORM_STRING_LEN = 5


def team_record(contests: DataFrame) -> DataFrame:
    """A1: home and away W/D/L counts and contests played per team."""
    tl = team_long(contests)
    h, a = F.col("is_home"), ~F.col("is_home")
    return tl.groupBy("div", "team").agg(
        F.count_if(h & (F.col("result") == "W")).alias("home_wins"),
        F.count_if(h & (F.col("result") == "D")).alias("home_draws"),
        F.count_if(h & (F.col("result") == "L")).alias("home_losses"),
        F.count_if(a & (F.col("result") == "W")).alias("away_wins"),
        F.count_if(a & (F.col("result") == "D")).alias("away_draws"),
        F.count_if(a & (F.col("result") == "L")).alias("away_losses"),
        F.count(F.lit(1)).alias("matches_played"))


def team_stats(contests: DataFrame) -> DataFrame:
    """A3: lifetime table per team (the reference's processed team table)."""
    tl = team_long(contests)
    n = F.count(F.lit(1))
    wins = F.sum("win")
    hn, an = F.count_if(F.col("is_home")), F.count_if(~F.col("is_home"))
    hw, aw = F.sum(F.when(F.col("is_home"), F.col("win"))), F.sum(F.when(~F.col("is_home"), F.col("win")))
    gf, ga = F.sum("gf"), F.sum("ga")
    return tl.groupBy("div", "team").agg(
        n.alias("matches"), wins.cast("long").alias("wins"), F.sum("draw").cast("long").alias("draws"),
        F.sum("loss").cast("long").alias("losses"), (wins / n).alias("win_rate"),
        gf.alias("goals_for"), ga.alias("goals_against"), (gf - ga).alias("goal_diff"),
        (gf / n).alias("avg_goals_scored"), (ga / n).alias("avg_goals_conceded"),
        F.when(hn > 0, hw / hn).alias("home_win_rate"), F.when(an > 0, aw / an).alias("away_win_rate"))


def team_list(contests: DataFrame) -> DataFrame:
    """U4: every team that appears on either side (one scan: explode of both names)."""
    return (contests.select("div", F.explode(F.array("home_team", "away_team")).alias("team"))
            .distinct())


def bounded(limit: int) -> int:
    """The limit of a recent-contests query must lie in ``LIMITS``."""
    if not LIMITS[0] <= limit <= LIMITS[1]:
        raise ValueError(f"limit must be between {LIMITS[0]} and {LIMITS[1]}, got {limit}")
    return limit


def recent_matches(contests: DataFrame, limit: int = RECENT_DEFAULT) -> DataFrame:
    """O1 without a team filter: the latest ``limit`` contests (top-k, TakeOrderedAndProject)."""
    return (contests.select("match_id", "match_date", "div", "home_team", "away_team",
                            F.col("fthg").alias("home_goals"), F.col("ftag").alias("away_goals"),
                            F.col("ftr").alias("result"))
            .orderBy(F.col("match_date").desc(), F.col("match_id").desc()).limit(bounded(limit)))


def recent_matches_by_team(contests: DataFrame, limit: int = RECENT_DEFAULT) -> DataFrame:
    """O1 with the team filter, for every team at once: the latest ``limit`` contests per team."""
    tl = team_long(contests)
    w = Window.partitionBy("div", "team").orderBy(F.col("match_date").desc(), F.col("match_id").desc())
    return (tl.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= bounded(limit))
            .select("div", "team", "rank", "match_id", "match_date", "opponent", "is_home", "gf", "ga", "result"))


def h2h_summary(contests: DataFrame) -> DataFrame:
    """A2: per unordered pair (canonical ``pair_lo < pair_hi``): meetings, wins of each, draws."""
    p = contests.select("div", *pair_key("home_team", "away_team"), "home_team", "ftr")
    lo_won = ((F.col("home_team") == F.col("pair_lo")) & (F.col("ftr") == "H")) | \
             ((F.col("home_team") != F.col("pair_lo")) & (F.col("ftr") == "A"))
    return p.groupBy("div", "pair_lo", "pair_hi").agg(
        F.count(F.lit(1)).alias("total_meetings"),
        F.count_if(lo_won).alias("lo_wins"),
        F.count_if((F.col("ftr") != "D") & ~lo_won).alias("hi_wins"),
        F.count_if(F.col("ftr") == "D").alias("draws"))


def h2h_recent(contests: DataFrame, limit: int = RECENT_DEFAULT) -> DataFrame:
    """O2: the latest ``limit`` meetings of every pair."""
    p = contests.select("div", *pair_key("home_team", "away_team"), "match_id", "match_date", "home_team",
                        "away_team", F.col("fthg").alias("home_goals"), F.col("ftag").alias("away_goals"),
                        F.col("ftr").alias("result"))
    w = Window.partitionBy("div", "pair_lo", "pair_hi").orderBy(F.col("match_date").desc(), F.col("match_id").desc())
    return p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= bounded(limit))


def recent_form(contests: DataFrame, n: int = FORM_STRING_LEN) -> DataFrame:
    """Last ``n`` results per team, oldest → newest, e.g. ``WWDLW``.

    ``row_number() <= n`` first (partial group limit), so the ``collect_list`` that follows holds
    at most ``n`` elements per team.
    """
    tl = team_long(contests)
    w = Window.partitionBy("div", "team").orderBy(F.col("match_date").desc(), F.col("match_id").desc())
    last = tl.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
    return last.groupBy("div", "team").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("match_date", "match_id", "result"))),
                                 lambda x: x["result"]), "").alias("recent_form"))
