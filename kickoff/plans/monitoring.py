"""Monitoring and extra model jobs from the reference's declared modules.

They read the contest table (and the model-ready table for R16); every result is an
aggregation whose size is bounded by seasons, months, classes or price levels.
"""

from __future__ import annotations

from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import prices as P
from ..sources.contests import contests
from . import features as FE
from . import training as TR

PSI_BUCKETS = 10
PSI_FLOOR = 1e-4


def psi_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population stability index of the bookmaker's home probability, each season against
    the previous one (10 equal-width buckets on [0, 1], shares floored at 1e-4)."""
    c = contests(spark, sf_dir).select("season", *P.implied_probabilities()).where(F.col("odds_prob_home").isNotNull())
    b = F.least(F.floor(F.col("odds_prob_home") * PSI_BUCKETS), F.lit(PSI_BUCKETS - 1)).cast("int")
    counts = c.groupBy("season", b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    seasons = c.groupBy("season").agg(F.count(F.lit(1)).alias("total"))  # one row per season
    grid = seasons.select("season", "total", F.explode(F.sequence(F.lit(0), F.lit(PSI_BUCKETS - 1))).alias("bucket"))
    shares = (grid.join(counts, ["season", "bucket"], "left")
              .withColumn("share", F.greatest(F.coalesce(F.col("n"), F.lit(0)) / F.col("total"), F.lit(PSI_FLOOR))))
    w = Window.partitionBy("bucket").orderBy("season")
    terms = shares.withColumn("prev", F.lag("share").over(w)).where(F.col("prev").isNotNull())
    return terms.groupBy("season").agg(
        F.round(F.sum((F.col("share") - F.col("prev")) * F.ln(F.col("share") / F.col("prev"))), 9).alias("psi"))


def accuracy_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmaker-pick accuracy per month and over the trailing three months."""
    c = contests(spark, sf_dir).select("match_date", "ftr", *P.implied_probabilities()).withColumn("pick", P.bookmaker_pick())
    m = (c.groupBy(F.trunc("match_date", "month").alias("month"))
         .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("pick") == F.col("ftr"), F.lit(False))).alias("hits")))
    w = Window.orderBy("month").rowsBetween(-2, 0)  # one row per month: bounded by the calendar
    return m.select("month", "n", (F.col("hits") / F.col("n")).alias("accuracy"),
                    (F.sum("hits").over(w) / F.sum("n").over(w)).alias("accuracy_3m"))


def auc_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-vs-rest ROC-AUC of the bookmaker's implied probabilities, by the rank-sum
    (Mann–Whitney) formula with average ranks for ties. Rows are first reduced to one row per
    (class, distinct score) — price levels are a bounded grid — so the ordered window runs on
    that small table."""
    c = contests(spark, sf_dir).select("ftr", *P.implied_probabilities()).where(F.col("odds_prob_home").isNotNull())
    long = c.select("ftr", F.explode(F.array(
        F.struct(F.lit("A").alias("cls"), F.col("odds_prob_away").alias("score")),
        F.struct(F.lit("D").alias("cls"), F.col("odds_prob_draw").alias("score")),
        F.struct(F.lit("H").alias("cls"), F.col("odds_prob_home").alias("score")))).alias("s"))
    g = (long.groupBy(F.col("s.cls").alias("cls"), F.col("s.score").alias("score"))
         .agg(F.count(F.lit(1)).alias("cnt"), F.count_if(F.col("ftr") == F.col("s.cls")).alias("pos")))
    w = Window.partitionBy("cls").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("before", F.coalesce(F.sum("cnt").over(w), F.lit(0)))
    g = g.withColumn("avg_rank", F.col("before") + (F.col("cnt") + F.lit(1.0)) / 2.0)
    agg = g.groupBy("cls").agg(F.sum(F.col("pos") * F.col("avg_rank")).alias("rank_sum"),
                               F.sum("pos").alias("n_pos"), F.sum("cnt").alias("n"))
    n_neg = F.col("n") - F.col("n_pos")
    auc = (F.col("rank_sum") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0) / (F.col("n_pos") * n_neg)
    return agg.select("cls", "n_pos", n_neg.alias("n_neg"), F.round(auc, 12).alias("auc"))


def goals_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poisson GLMs for home and away goals on the model features (fit rows), scored on
    the test rows."""
    data = TR.prepare(FE.model_ready(FE.match_features(spark, sf_dir)))
    cols = TR.usable_features(data, TR.feature_columns(data))
    x = TR.assemble(data, cols)
    fit, test = x.where(F.col("split") == "fit"), x.where(F.col("split") == "test")
    out = test.select("match_id", "home_goals", "away_goals", "features")
    for side in ("home_goals", "away_goals"):
        glm = GeneralizedLinearRegression(family="poisson", link="log", labelCol=side, featuresCol="features",
                                          predictionCol="expected_" + side, maxIter=50, regParam=1e-4)
        out = glm.fit(fit.withColumn(side, F.col(side).cast("double"))).transform(out)
    return out.select("match_id", "home_goals", "away_goals", "expected_home_goals", "expected_away_goals")
