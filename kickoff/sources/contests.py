"""The contest table derived from the driver's ``orders`` table.

The driver ships no contests, so every contest is derived from one ``orders`` row by integer
arithmetic (one narrow projection over a parquet scan: no shuffle, grows with ``orders``).
Column names are lower-case versions of the reference's match schema:

    match_id, match_date, div, home_team, away_team, fthg, ftag, ftr, hs, aws, hst, ast,
    b365h, b365d, b365a, season_start, season

Teams are scoped by ``div`` (the rating pool): the key of a team is ``(div, team)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import season_label, season_start
from ..functions.keys import result_code
from .tables import read_table

# Fixed values of the derivation (FIXTURES.md §2): pool and team counts, missing-shot and
# missing-price moduli, and the price ranges in cents.
N_POOLS = 10
N_TEAMS = 20
NO_SHOTS_MOD = 17
NO_PRICE_MOD = 23


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")


def _derive(o: DataFrame) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    no_shots = (k % NO_SHOTS_MOD) == 0
    no_price = (k % NO_PRICE_MOD) == 0
    home_idx = c % N_TEAMS
    away_idx = (home_idx + 1 + F.expr("o_orderkey div 10") % 19) % N_TEAMS
    null_d = F.lit(None).cast("double")

    def price(lo, mult, span):
        return F.when(no_price, null_d).otherwise((F.lit(lo) + (k * mult) % span).cast("double") / 100)

    return o.select(
        k.alias("match_id"),
        F.to_date("o_orderdate").alias("match_date"),
        F.concat(F.lit("L"), (k % N_POOLS).cast("string")).alias("div"),
        F.concat(F.lit("T"), home_idx.cast("string")).alias("home_team"),
        F.concat(F.lit("T"), away_idx.cast("string")).alias("away_team"),
        ((k * 7 + c) % 5).alias("fthg"),
        ((k * 11 + c * 3) % 4).alias("ftag"),
        F.when(no_shots, F.lit(0)).otherwise(1 + (k * 13 + c) % 20).cast("long").alias("hs"),
        F.when(no_shots, F.lit(0)).otherwise(1 + (k * 5 + c) % 18).cast("long").alias("aws"),
        F.when(no_shots, F.lit(0)).otherwise((k * 3 + c) % 9).cast("long").alias("hst"),
        F.when(no_shots, F.lit(0)).otherwise((k * 9 + c) % 8).cast("long").alias("ast"),
        price(120, 17, 400).alias("b365h"),
        price(280, 31, 200).alias("b365d"),
        price(130, 19, 600).alias("b365a"),
    )


def with_season(df: DataFrame, date_col: str = "match_date") -> DataFrame:
    return df.withColumn("season_start", season_start(date_col)).withColumn("season", season_label(date_col))


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean contest history (one row per played contest)."""
    df = _derive(_base(spark, sf_dir))
    df = df.withColumn("ftr", result_code("fthg", "ftag"))
    return with_season(df)


def dirty_contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-file shaped contests for the ingest and quality jobs (FIXTURES.md §2, dirty variant).

    Text dates (``dd/MM/yyyy``, with two-digit years, unpadded, or both, by key), ``NH`` results, null
    goals, blank-padded names and repeated rows — the defects the cleaner must repair.
    """
    d = _derive(_base(spark, sf_dir))
    k = F.col("match_id")
    ftr = F.when(k % 97 == 0, F.lit("NH")).otherwise(result_code("fthg", "ftag"))
    null_goals = (k % 89) == 0
    pad = (k % 13) == 0
    form = k % 10
    out = d.select(
        "match_id", "div",
        F.when(form == 3, F.date_format("match_date", "dd/MM/yy")).when(form == 4, F.date_format("match_date", "d/M/yyyy"))
         .when(form == 6, F.date_format("match_date", "d/M/yy"))
         .otherwise(F.date_format("match_date", "dd/MM/yyyy")).alias("date_text"),
        F.when(pad, F.concat(F.lit("  "), "home_team", F.lit(" "))).otherwise(F.col("home_team")).alias("home_team"),
        F.when(pad, F.concat(F.lit(" "), "away_team", F.lit("  "))).otherwise(F.col("away_team")).alias("away_team"),
        F.when(null_goals, F.lit(None).cast("long")).otherwise(F.col("fthg")).alias("fthg"),
        F.col("ftag"), ftr.alias("ftr"), "hs", "aws", "hst", "ast", "b365h", "b365d", "b365a",
        F.col("match_date").alias("_true_date"))
    repeats = out.where(k % 101 == 0)
    return out.unionByName(repeats)
