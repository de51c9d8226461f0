"""Contest rows → team-long rows (two per contest, one per side)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import points, side_result

TEAM_LONG_COLUMNS = ["match_id", "match_date", "div", "season_start", "season", "team", "opponent",
                     "is_home", "gf", "ga", "result", "points", "win", "draw", "loss", "clean_sheet",
                     "shots_for", "shots_against", "sot_for", "sot_against"]


def team_long(contests: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Mirror every contest into a home row and an away row in ONE pass (``explode`` of a
    two-element array), so the scan is read once and no union of two scans is planned.

    Result is seen from the row's team: W/D/L, points 3/1/0, goals and shots for/against.
    ``carry`` columns (match-level payload such as prices) ride on the home row only (null on the
    away row), so a later pivot back to one row per contest needs no second scan or join.
    """
    carry = list(carry or [])
    cols = set(contests.columns)
    has_shots = {"hs", "aws"} <= cols
    has_sot = {"hst", "ast"} <= cols
    null = F.lit(None).cast("long")

    def side(home: bool):
        t, o = ("home_team", "away_team") if home else ("away_team", "home_team")
        g, a = ("fthg", "ftag") if home else ("ftag", "fthg")
        s, sa = ("hs", "aws") if home else ("aws", "hs")
        st, sta = ("hst", "ast") if home else ("ast", "hst")
        return F.struct(F.lit(home).alias("is_home"), F.col(t).alias("team"), F.col(o).alias("opponent"),
                        F.col(g).alias("gf"), F.col(a).alias("ga"),
                        (F.col(s) if has_shots else null).alias("shots_for"),
                        (F.col(sa) if has_shots else null).alias("shots_against"),
                        (F.col(st) if has_sot else null).alias("sot_for"),
                        (F.col(sta) if has_sot else null).alias("sot_against"),
                        *[(F.col(x) if home else F.lit(None).cast(contests.schema[x].dataType)).alias("c_" + x)
                          for x in carry])

    keep = [c for c in ("match_id", "match_date", "div", "season_start", "season", "ftr") if c in cols]
    tl = (contests.select(*keep, F.explode(F.array(side(True), side(False))).alias("_s"))
          .select(*keep, "_s.*"))
    for x in carry:
        tl = tl.withColumnRenamed("c_" + x, x) if x != "ftr" else tl.withColumnRenamed("c_ftr", "m_ftr")
    res = side_result("ftr", "is_home")
    return (tl.withColumn("result", res)
              .withColumn("points", points(F.col("result")))
              .withColumn("win", (F.col("result") == "W").cast("int"))
              .withColumn("draw", (F.col("result") == "D").cast("int"))
              .withColumn("loss", (F.col("result") == "L").cast("int"))
              .withColumn("clean_sheet", (F.col("ga") == 0).cast("int"))
              .drop("ftr")
              .withColumnRenamed("m_ftr", "ftr"))
