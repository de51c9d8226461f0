"""EDA job: rest days, live league position and their relation to the outcome (W8, W9, T1–T5,
A5, A6, O4, J5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import numeric_target
from ..operators import stats as ST
from ..operators.league import live_positions
from ..sources.contests import contests
from . import features as FE

REST = ["home_rest_days", "away_rest_days", "rest_diff"]
POS = ["home_league_pos", "away_league_pos", "league_pos_diff"]
# Existing features the reference checks the new ones against (T5).
CHECK_COLS = ["elo_diff", "diff_season_win_rate", "diff_season_ppg", "diff_form5_points", "odds_home_away_diff"]


def rest_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days since each side's previous contest (row order), and their difference."""
    tf = FE.side_features(spark, sf_dir, ["rest"])
    return (tf.groupBy("match_id").agg(F.max_by("rest_days", F.col("is_home")).alias("home_rest_days"),
                                       F.min_by("rest_days", F.col("is_home")).alias("away_rest_days"))
        .withColumn("rest_diff", F.col("home_rest_days") - F.col("away_rest_days")))


def eda_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contests with rest days, live positions and the numeric target (one row per contest)."""
    c = contests(spark, sf_dir).select("match_id", "match_date", "div", "home_team", "away_team", "ftr",
                                       numeric_target("ftr").alias("target_num"))
    return c.join(rest_days(spark, sf_dir), "match_id").join(live_positions(contests(spark, sf_dir)), "match_id")


def rest_frame(t: DataFrame) -> DataFrame:
    return t.where(F.col("home_rest_days").isNotNull() & F.col("away_rest_days").isNotNull())


def pos_frame(t: DataFrame) -> DataFrame:
    return t.where(F.col("home_league_pos").isNotNull() & F.col("away_league_pos").isNotNull())


def new_feature_corr(spark: SparkSession, sf_dir: str, digits: int | None = ST.R_DIGITS) -> DataFrame:
    """T1 for the two new feature families, each on its own complete-case frame."""
    t = eda_table(spark, sf_dir)
    return ST.correlations(rest_frame(t), REST, digits=digits).unionByName(ST.correlations(pos_frame(t), POS, digits=digits))


def anova_new(spark: SparkSession, sf_dir: str, digits: int | None = ST.R_DIGITS) -> DataFrame:
    """T3 for ``rest_diff`` and ``league_pos_diff`` across H/D/A."""
    t = eda_table(spark, sf_dir)
    return ST.anova(rest_frame(t), "rest_diff", digits=digits).unionByName(
        ST.anova(pos_frame(t), "league_pos_diff", digits=digits))


def significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-values and markers for the correlations and ANOVAs above, from the unrounded statistics."""
    corr = (new_feature_corr(spark, sf_dir, None).withColumn("p_value", ST.p_from_r("r", "n"))
            .select("feature", F.lit("pearson").alias("test"), F.round("r", ST.R_DIGITS).alias("statistic"), "p_value"))
    an = (anova_new(spark, sf_dir, None).withColumn("p_value", ST.p_from_f("f_stat", "df_between", "df_within"))
          .select("feature", F.lit("anova").alias("test"), F.round("f_stat", ST.R_DIGITS).alias("statistic"), "p_value"))
    return corr.unionByName(an).withColumn("marker", ST.stars("p_value"))


def outcome_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: mean / median of the two differences per outcome."""
    t = eda_table(spark, sf_dir)
    return (ST.group_summary(rest_frame(t), "rest_diff")
            .unionByName(ST.group_summary(pos_frame(t), "league_pos_diff")))


def avg_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average live position of every team over both sides."""
    t = pos_frame(eda_table(spark, sf_dir))
    sides = t.select("div", F.explode(F.array(
        F.struct(F.col("home_team").alias("team"), F.col("home_league_pos").alias("pos")),
        F.struct(F.col("away_team").alias("team"), F.col("away_league_pos").alias("pos")))).alias("s"))
    return sides.groupBy("div", F.col("s.team").alias("team")).agg(F.avg("s.pos").alias("avg_position"),
                                                                   F.count(F.lit(1)).alias("n"))


def model_numeric_cols(mr: DataFrame) -> list[str]:
    skip = {"home_goals", "away_goals", "target_num", "match_id"}
    return [f.name for f in mr.schema.fields
            if f.dataType.typeName() in ("double", "integer", "long") and f.name not in skip]


def existing_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: r of every numeric model-ready column with the numeric target."""
    mr = FE.model_ready(FE.match_features(spark, sf_dir)).withColumn("target_num", numeric_target("target"))
    return ST.correlations(mr, model_numeric_cols(mr)).where(F.col("r").isNotNull())


def corr_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existing correlations plus the two new differences, top 20 by |r|."""
    new = new_feature_corr(spark, sf_dir).where(F.col("feature").isin("rest_diff", "league_pos_diff"))
    return ST.rank_by_abs(existing_corr(spark, sf_dir).unionByName(new)).select("rank", "feature", "r")


def collinearity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R of the new differences with five existing features, on contests having both."""
    mr = FE.model_ready(FE.match_features(spark, sf_dir), wanted=CHECK_COLS)
    t = eda_table(spark, sf_dir).select("match_id", *POS, *REST)
    merged = mr.join(t.where(F.col("league_pos_diff").isNotNull() & F.col("rest_diff").isNotNull()), "match_id")
    out = None
    for new in ("league_pos_diff", "rest_diff"):
        part = ST.correlations(merged.withColumn("_t", F.col(new)), CHECK_COLS, target="_t").select(
            F.lit(new).alias("new_feature"), F.col("feature"), "n", "r")
        out = part if out is None else out.unionByName(part)
    return out
