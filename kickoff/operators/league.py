"""Live league position of both sides before every contest.

The position of a team at contest ``m`` is its rank among teams of the same pool and season that
have played, by points, goal difference and goals for (descending), ties keeping first-seen
order; null for an unplayed team or when fewer than two teams have played. Earlier contests of
the same day count (row order), as in the reference's EDA job.

Points and goals are sums, so a season is cut into blocks of whole days that are folded side by side.
A block starts from *seed* rows: the totals of every team over the earlier blocks of the season and the order
in which the teams were first seen, from one aggregation per (team, block) and a join of blocks with
earlier blocks (a season has at most ``366 / days`` of them). Seeds and contests go through one exchange on
(pool, season, block), are sorted, and are folded as a stream of Arrow batches; the state is one small
record per team of the block's season. The length of a block comes from the hottest (pool, season), so that none holds much more than
``BLOCK_CONTESTS``; seasons that all stay below it are one block each and need no seeds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "match_id long, home_league_pos int, away_league_pos int"
BLOCK_CONTESTS = 200_000
SEASON_DAYS = 366
_KEY = ["div", "season", "block"]


def _sides(contests: DataFrame) -> DataFrame:
    """Both sides of every contest: points, goal difference, goals, and when it was seen."""
    def side(team, own, other, win, order):
        points = F.when(F.col("ftr") == win, 3).when(F.col("ftr") == "D", 1).otherwise(0)
        return F.struct(F.col(team).alias("team"), points.cast("long").alias("points"),
                        (F.col(own) - F.col(other)).cast("long").alias("diff"), F.col(own).cast("long").alias("scored"),
                        F.struct("match_date", "match_id", F.lit(order).alias("side")).alias("seen"))
    both = F.explode(F.array(side("home_team", "fthg", "ftag", "H", 0), side("away_team", "ftag", "fthg", "A", 1)))
    return contests.select(*_KEY, both.alias("s")).select(*_KEY, "s.*")


def seeds(contests: DataFrame) -> DataFrame:
    """Per (pool, season, block) the table before its first day: one row for every team seen earlier."""
    held = _sides(contests).groupBy(*_KEY, "team").agg(F.sum("points").alias("points"), F.sum("diff").alias("diff"),
                                                      F.sum("scored").alias("scored"), F.count(F.lit(1)).alias("played"),
                                                      F.min("seen").alias("seen"))
    blocks = contests.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).select("div", "season", F.col("block").alias("to"))
    before = (held.join(blocks, ["div", "season"]).where(F.col("block") < F.col("to"))
              .groupBy("div", "season", F.col("to").alias("block"), "team")
              .agg(*(F.sum(c).alias(c) for c in ("points", "diff", "scored", "played")), F.min("seen").alias("seen")))
    place = F.row_number().over(Window.partitionBy(*_KEY).orderBy("seen"))
    return before.select(*_KEY, "team", "points", "diff", "scored", "played", place.cast("long").alias("place"))


class _Table:
    """Standings of one season: team → [points, goal difference, goals, first-seen order]; every listed team has played."""

    def __init__(self) -> None:
        self.teams: dict = {}

    def position(self, team):
        own = self.teams.get(team)
        if own is None or len(self.teams) < 2:
            return None
        rank = (-own[0], -own[1], -own[2], own[3])
        return 1 + sum((-p, -d, -g, seen) < rank for p, d, g, seen in self.teams.values())

    def add(self, team, points, diff, scored) -> None:
        row = self.teams.setdefault(team, [0, 0, 0, len(self.teams)])
        row[0] += points
        row[1] += diff
        row[2] += scored


def _fold(batches):
    key, table = None, _Table()
    columns = [*_KEY, "kind", "match_id", "home_team", "away_team", "fthg", "ftag", "ftr", "points", "diff", "scored"]
    for pdf in batches:
        out = []
        for div, season, block, kind, match_id, home, away, hg, ag, ftr, points, diff, scored in zip(
                *(pdf[c].tolist() for c in columns)):
            if (div, season, block) != key:  # sorted by key: a finished table is dropped
                key, table = (div, season, block), _Table()
            if kind == 0:
                table.add(home, int(points), int(diff), int(scored))
                continue
            out.append((match_id, table.position(home), table.position(away)))
            won = {"H": (3, 0), "A": (0, 3)}.get(ftr, (1, 1))
            hg, ag = int(hg), int(ag)
            table.add(home, won[0], hg - ag, hg)
            table.add(away, won[1], ag - hg, ag)
        ids, first, second = zip(*out) if out else ((), (), ())
        yield pd.DataFrame({"match_id": pd.array(ids, dtype="int64"), "home_league_pos": pd.array(first, dtype="Int32"),
                            "away_league_pos": pd.array(second, dtype="Int32")})


def block_days(contests: DataFrame) -> int:
    """Days of a block: a whole season, or the share of it in which the hottest (pool, season) has ``BLOCK_CONTESTS`` contests."""
    hottest = contests.groupBy("div", "season").count().agg(F.max("count")).first()[0] or 0
    return SEASON_DAYS if hottest <= BLOCK_CONTESTS else max(1, SEASON_DAYS * BLOCK_CONTESTS // hottest)


def live_positions(contests: DataFrame, days: int | None = None) -> DataFrame:
    """W9; ``days`` is the length of a block (default: from the data) and does not change the result."""
    days = days or block_days(contests)
    split = days < SEASON_DAYS
    block = F.floor(F.datediff("match_date", F.lit("1970-01-01").cast("date")) / days).cast("long") if split else F.lit(0).cast("long")
    rows = contests.select("div", "season", block.alias("block"), "match_date", "match_id", "home_team", "away_team",
                           "fthg", "ftag", "ftr").withColumn("kind", F.lit(1))
    extra = {c: F.lit(None).cast("long") for c in ("points", "diff", "scored")}
    stream = rows.withColumns(extra)
    if split:
        start = seeds(rows).select(*_KEY, F.lit(0).alias("kind"), F.col("team").alias("home_team"), "points", "diff", "scored",
                                   F.col("place").alias("match_id"))
        stream = rows.unionByName(start, allowMissingColumns=True)
    ordered = stream.repartition(*_KEY).sortWithinPartitions(*_KEY, "kind", "match_date", "match_id")
    return (ordered.mapInPandas(_fold, SCHEMA)
            .withColumn("league_pos_diff", F.col("home_league_pos") - F.col("away_league_pos")))
