"""Serving: fixture checks, feature assembly with persisted medians, batch prediction.

Everything is a distributed batch over a fixtures DataFrame — no per-fixture loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prices as P
from ..session import fresh_path, materialize
from ..sources.contests import contests
from . import features as FE
from . import training as TR

FIXTURE_DAYS = 30


def split_history(spark: SparkSession, sf_dir: str, days: int = FIXTURE_DAYS):
    """History = contests before the last ``days`` days; fixtures = the contests inside them,
    with results and prices removed (they are what a user asks to score)."""
    c = contests(spark, sf_dir)
    cut = F.date_sub(c.agg(F.max("match_date")).scalar(), days)
    hist = c.where(F.col("match_date") <= cut)
    fx = c.where(F.col("match_date") > cut).select("match_id", "match_date", "div", "home_team", "away_team",
                                                   "season_start", "season")
    return hist, fx


def with_hard_cases(fixtures: DataFrame) -> DataFrame:
    """Fixtures as a careless caller sends them: some unknown home and away sides, some sides against themselves."""
    k = F.col("match_id")
    home = F.when(k % 11 == 0, F.concat(F.lit("X"), "home_team")).otherwise(F.col("home_team"))
    away = F.when(k % 13 == 0, home).when(k % 7 == 0, F.concat(F.lit("Y"), "away_team")).otherwise(F.col("away_team"))
    return fixtures.select(*(home.alias(c) if c == "home_team" else away.alias(c) if c == "away_team" else c
                             for c in fixtures.columns))


def check_fixtures(fixtures: DataFrame, history: DataFrame):
    """(accepted, rejected). Unknown teams via anti-joins against the history's team list
    (one row per team: partial aggregation makes it small), same-side fixtures rejected too."""
    teams = history.select("div", F.explode(F.array("home_team", "away_team")).alias("team")).distinct()
    known_h = teams.select("div", F.col("team").alias("home_team"))
    known_a = teams.select("div", F.col("team").alias("away_team"))
    unknown_h = fixtures.join(known_h, ["div", "home_team"], "left_anti").select("match_id", F.lit("unknown_home").alias("reason"))
    unknown_a = fixtures.join(known_a, ["div", "away_team"], "left_anti").select("match_id", F.lit("unknown_away").alias("reason"))
    same = fixtures.where(F.col("home_team") == F.col("away_team")).select("match_id", F.lit("same_team").alias("reason"))
    rejected = unknown_h.unionByName(unknown_a).unionByName(same)
    accepted = (fixtures.join(known_h, ["div", "home_team"], "left_semi").join(known_a, ["div", "away_team"], "left_semi")
                .where(F.col("home_team") != F.col("away_team")))
    return accepted, rejected


def fixture_features(history: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Model features of fixtures from the history strictly before each fixture date:
    as-of team states (J1), as-of Elo (J3), differences and calendar; no prices, no result."""
    from ..functions.calendar import temporal_columns
    from ..operators.asof import asof_features
    from ..operators.elo import elo_asof, elo_history

    sides = asof_features(history, fixtures)
    s_cols = [c for c in FE.SIDE_FEATURES if c in sides.columns]
    g = sides.groupBy("match_id").agg(
        F.max_by(F.struct(*s_cols, *FE.H2H), F.col("is_home")).alias("h"),
        F.min_by(F.struct(*s_cols), F.col("is_home")).alias("a"))
    wide = g.select("match_id", *[F.col("h." + c).alias("home_" + c) for c in s_cols],
                    *[F.col("a." + c).alias("away_" + c) for c in s_cols], *[F.col("h." + c).alias(c) for c in FE.H2H])
    elo = elo_asof(fixtures, elo_history(history))
    out = fixtures.join(wide, "match_id", "left").join(elo, "match_id", "left")
    return out.select("*", *FE.diff_columns(), *temporal_columns("match_date"))


def save_medians(spark: SparkSession, medians: dict, name: str) -> str:
    """Training medians as a one-row parquet table next to the model."""
    path = fresh_path(spark, "medians-" + name)
    cols = sorted(medians)
    spark.createDataFrame([tuple(float(medians[c]) if medians[c] is not None else None for c in cols)],
                          ", ".join(f"`{c}` double" for c in cols)).write.parquet(path)
    return path


def assemble(features: DataFrame, medians: DataFrame, cols: list[str]) -> DataFrame:
    """Each model feature → itself, else the training median, else 0.0. The one-row median
    table is attached as scalar subqueries (no join)."""
    out = features
    for c in cols:
        med = medians.select(F.col(f"`{c}`")).scalar() if c in medians.columns else F.lit(None)
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), med, F.lit(0.0)))
    return out


def with_book(scored: DataFrame, quoted: DataFrame) -> DataFrame:
    """the bookmaker's home probability of each fixture, from the prices quoted for it (null without prices)."""
    book = quoted.select("match_id", P.implied_probabilities()[0].alias("book_home"))
    return scored.join(book, "match_id", "left")


def batch_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train all models (calibrated), then score every accepted fixture with the selected one:
    probabilities, predicted label, prices with margin, confidence, value edge vs the bookmaker's quoted prices
    (0 where none are quoted). The model itself does not see a fixture's prices."""
    data = materialize(TR.prepare(FE.model_ready(FE.match_features(spark, sf_dir))), "model-rows")
    cols = TR.usable_features(data, TR.feature_columns(data))
    fit = data.where(F.col("split") == "fit")
    model = TR.select_model(data, TR.train_models(data))
    from ..operators.medians import exact_medians
    med_path = save_medians(spark, exact_medians(fit, cols), "serving")
    medians = spark.read.parquet(med_path)

    hist, fx = split_history(spark, sf_dir)
    accepted, _ = check_fixtures(fx, hist)
    x = fixture_features(hist, accepted)
    for c in FE.ODDS:
        if c in cols:
            x = x.withColumn(c, F.lit(None).cast("double"))  # fixtures carry no prices
    x = assemble(x, medians, cols)
    scored = with_book(model.probabilities(x), contests(spark, sf_dir))
    pmax = F.greatest(*[F.col(c) for c in TR.PROBS])
    return scored.select(
        "match_id", "match_date", "div", "home_team", "away_team",
        F.col("prob_H").alias("prob_home_win"), F.col("prob_D").alias("prob_draw"), F.col("prob_A").alias("prob_away_win"),
        "predicted", P.prices("prob_H", "prob_D", "prob_A").alias("prices"),
        P.confidence(pmax).alias("confidence"),
        P.value_edge("prob_H", "book_home").alias("value_home"))
