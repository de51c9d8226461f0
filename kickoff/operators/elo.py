"""Elo ratings as an ordered fold per rating pool.

The rating after a contest depends on both sides' ratings before it, so inside one pool the
recurrence is serial by definition and cannot be a window. Pools are independent, so:

    repartition(pool) → sortWithinPartitions(pool, date, id) → mapInPandas(fold)

The sort is Spark's external sorter (spills, bounded memory); the fold consumes the sorted
partition as a stream of Arrow batches and keeps only ``{(pool, team): rating}`` — memory is
one batch plus one float per team, never a pool's whole history. Parallelism = number of pools.
Output is one row per contest with the pre- and post-contest ratings of both sides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Reference defaults for K, home advantage and the initial rating.
ELO_K = 20
ELO_HOME_ADVANTAGE = 100
ELO_INITIAL = 1500

HISTORY_SCHEMA = ("match_id long, div string, match_date date, home_team string, away_team string, "
                  "home_elo double, away_elo double, home_elo_post double, away_elo_post double")


def with_stakes(contests: DataFrame, k: float = ELO_K) -> DataFrame:
    """What a contest puts at stake, as columns: ``score`` (home side's share of the points) and ``stake``
    (K times a factor that grows with the log of the winning margin). Neither depends on a rating."""
    share = F.when(F.col("ftr") == "H", 1.0).when(F.col("ftr") == "A", 0.0).otherwise(0.5)
    margin = F.abs(F.col("fthg") - F.col("ftag")).cast("double")
    return contests.withColumns({"score": share, "stake": F.lit(float(k)) * (F.log(margin + 1) + 1)})


def transfer(ratings: dict, home, away, score: float, stake: float, edge: float, initial: float) -> tuple[float, float, float]:
    """Move one zero-sum amount between two ratings; returns both ratings before and the amount."""
    mine, theirs = ratings.get(home, initial), ratings.get(away, initial)
    amount = stake * (score - 1.0 / (1.0 + 10.0 ** ((theirs - mine - edge) / 400.0)))
    ratings[home], ratings[away] = mine + amount, theirs - amount
    return mine, theirs, amount


def apply_contests(pdf: pd.DataFrame, ratings: dict, edge: float, initial: float) -> pd.DataFrame:
    """Fold the rows of ``pdf`` (in order) into ``ratings``, keyed by (div, team)."""
    rows = [transfer(ratings, (d, h), (d, a), s, k, edge, initial)
            for d, h, a, s, k in zip(pdf["div"], pdf["home_team"], pdf["away_team"], pdf["score"], pdf["stake"])]
    home, away, moved = (np.array(c, dtype=float) for c in (zip(*rows) if rows else ((), (), ())))
    return pdf.assign(home_elo=home, away_elo=away, home_elo_post=home + moved, away_elo_post=away - moved)


def elo_history(contests: DataFrame, k: float = ELO_K, home_advantage: float = ELO_HOME_ADVANTAGE,
                initial: float = ELO_INITIAL, pool: str = "div", partitions: int | None = None) -> DataFrame:
    """Pre- and post-contest ratings of both sides for every played contest."""
    names = [c.split()[0] for c in HISTORY_SCHEMA.split(", ")]
    edge, start = float(home_advantage), float(initial)

    def fold(batches):
        ratings: dict = {}
        for pdf in batches:
            yield apply_contests(pdf, ratings, edge, start)[names]

    src = with_stakes(contests, k).select("match_id", F.col(pool).alias("div"), "match_date", "home_team", "away_team",
                                          "score", "stake")
    # by key only (no fixed count): AQE may coalesce small partitions; a pool never splits
    part = src.repartition(partitions, "div") if partitions else src.repartition("div")
    ordered = part.sortWithinPartitions("div", "match_date", "match_id")
    return ordered.mapInPandas(fold, HISTORY_SCHEMA)


def team_ratings(history: DataFrame) -> DataFrame:
    """Post-contest rating per (div, team, contest): both sides of the history, one row each."""
    side = F.explode(F.array(
        F.struct(F.col("home_team").alias("team"), F.col("home_elo_post").alias("rating")),
        F.struct(F.col("away_team").alias("team"), F.col("away_elo_post").alias("rating"))))
    return history.select("div", "match_date", "match_id", side.alias("s")).select(
        "div", "match_date", "match_id", "s.team", "s.rating")


def elo_current(history: DataFrame) -> DataFrame:
    """Each team's rating after its last contest (``max_by`` over (date, id); partial
    aggregation map-side, so a hot team never gathers its rows in one place)."""
    return (team_ratings(history).groupBy("div", "team")
            .agg(F.max_by("rating", F.struct("match_date", "match_id")).alias("rating")))


def elo_features(history: DataFrame) -> DataFrame:
    """Pre-contest ratings and their difference per played contest."""
    return history.select("match_id", "home_elo", "away_elo",
                          (F.col("home_elo") - F.col("away_elo")).alias("elo_diff"))


def elo_asof(fixtures: DataFrame, history: DataFrame, initial: float = ELO_INITIAL) -> DataFrame:
    """J3 for contests not in the history (fixtures): the rating after the side's last contest
    dated strictly before the fixture, else the initial rating (strict as-of, see README D5).

    As-of lookup without a range join: rating events are first reduced to the last rating of
    each ``(div, team, day)`` (partial ``max_by`` map-side, so the window below holds at most one
    row per team and day, however hot the team), then the distinct (team, day) pairs that fixtures ask for are
    unioned in, also one row per team and day; they sort before same-day events and ``last(rating, ignorenulls)`` over the preceding rows picks the
    latest earlier rating.
    """
    daily = (team_ratings(history).groupBy("div", "team", "match_date")
             .agg(F.max_by("rating", "match_id").alias("rating")))
    ev = daily.select("div", "team", "match_date", F.lit(1).alias("_kind"), "rating")
    probes = fixtures.select("div", "match_date", "match_id", F.explode(F.array(
        F.struct(F.col("home_team").alias("team"), F.lit(True).alias("is_home")),
        F.struct(F.col("away_team").alias("team"), F.lit(False).alias("is_home")))).alias("s")).select(
        "div", "s.team", "match_date", "match_id", "s.is_home")
    asked = probes.select("div", "team", "match_date").distinct().select(
        "*", F.lit(0).alias("_kind"), F.lit(None).cast("double").alias("rating"))
    w = Window.partitionBy("div", "team").orderBy("match_date", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    known = (ev.unionByName(asked).withColumn("elo", F.last("rating", ignorenulls=True).over(w)).where("_kind = 0")
             .select("div", "team", "match_date", F.coalesce("elo", F.lit(float(initial))).alias("elo")))
    sides = probes.join(known, ["div", "team", "match_date"]).select("match_id", "is_home", "elo")
    return (sides.groupBy("match_id").agg(
        F.first(F.when(F.col("is_home"), F.col("elo")), ignorenulls=True).alias("home_elo"),
        F.first(F.when(~F.col("is_home"), F.col("elo")), ignorenulls=True).alias("away_elo"))
        .withColumn("elo_diff", F.col("home_elo") - F.col("away_elo")))
