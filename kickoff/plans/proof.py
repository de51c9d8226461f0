"""Small registered queries, each with a DuckDB statement, for operators that otherwise only run inside a larger
job: label encoding, scaler statistics, training medians, prices as a struct, safe division, arg-max picks, the as-of
Elo rating, the serving fill, the model board with its run history, argument bounds, and the team windows over
fixed narrow blocks (the plan that large keys get)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prices as P
from ..operators import elo as EL
from ..operators import history as H
from ..operators import medians as MD
from ..operators import metrics as MT
from ..operators import splits as SP
from ..operators.league import live_positions
from ..session import fresh_path
from ..sources.contests import contests
from ..streaming import run as SR
from . import catalog as C
from . import features as FE
from . import oracle_sql as O
from . import scoring as SC
from . import training as TR

_NUMBERS = ["hs", "aws", "hst", "ast", "b365h", "b365d"]
_SPLIT = O.with_(O.CONTESTS) + """, ix AS (SELECT *, row_number() OVER (ORDER BY match_date, match_id) - 1 AS idx, COUNT(*) OVER () AS n FROM c),
sp AS (SELECT *, CASE WHEN idx < CAST(floor(n * 8e-1) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM ix)"""


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SP.time_split(SP.with_row_index(contests(spark, sf_dir)))


C.register("label_encode", "M1", O.with_(O.CONTESTS) + """
SELECT match_id, CASE ftr WHEN 'A' THEN 0e0 WHEN 'D' THEN 1e0 ELSE 2e0 END AS label FROM c""")(
    lambda spark, sf: contests(spark, sf).select("match_id", TR.label_col("ftr").alias("label")))


def _scaler_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = TR.population_scaler(_split(spark, sf_dir).where("split = 'train'"), _NUMBERS)  # one row to the driver
    return spark.createDataFrame([(c, round(m, 9), round(s, 9)) for c, (m, s) in stats.items()], "feature string, mean double, sd double")


C.register("scaler_stats", "M2", _SPLIT + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 9) AS mean, round(stddev_pop({c}), 9) AS sd FROM sp WHERE split = 'train'"
    for c in _NUMBERS))(_scaler_stats)


def _train_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    medians = MD.exact_medians(_split(spark, sf_dir).where("split = 'train'"), _NUMBERS)
    saved = spark.read.parquet(SC.save_medians(spark, medians, "proof"))  # M13: persisted next to the model
    return saved.unpivot([], _NUMBERS, "feature", "median")


C.register("train_medians", "M13,A4", _SPLIT + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST(median({c}) AS DOUBLE) AS median FROM sp WHERE split = 'train'" for c in _NUMBERS))(_train_medians)

C.register("safe_divide", "F6", O.with_(O.CONTESTS) + """
SELECT match_id, CASE WHEN hst IS NULL THEN NULL WHEN COALESCE(hs, 0) = 0 THEN 0e0 ELSE CAST(hst AS DOUBLE) / hs END AS accuracy,
  CASE WHEN b365h IS NULL THEN NULL WHEN COALESCE(ast, 0) = 0 THEN -1e0 ELSE b365h / ast END AS per_shot FROM c""")(
    lambda spark, sf: contests(spark, sf).select("match_id", P.safe_divide("hst", "hs").alias("accuracy"),
                                                 P.safe_divide("b365h", "ast", -1.0).alias("per_shot")))

_ODDS = O.with_(O.CONTESTS) + ", i AS (SELECT match_id, ftr, " + O.odds_cols() + " FROM c)"


def _odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contests(spark, sf_dir).select("match_id", "ftr", *P.implied_probabilities())


C.register("argmax_pick", "F13", _ODDS + """
SELECT match_id, CASE WHEN odds_prob_away >= odds_prob_draw AND odds_prob_away >= odds_prob_home THEN 'A'
  WHEN odds_prob_draw >= odds_prob_home THEN 'D' ELSE 'H' END AS pick FROM i WHERE odds_prob_home IS NOT NULL""")(
    lambda spark, sf: _odds(spark, sf).where("odds_prob_home is not null").select(
        "match_id", P.argmax_label("odds_prob_away", "odds_prob_draw", "odds_prob_home").alias("pick")))

C.register("price_struct", "F9", _ODDS + f"""
SELECT match_id, {C._price_sql('odds_prob_home')} AS home_win, {C._price_sql('odds_prob_draw')} AS draw,
  {C._price_sql('odds_prob_away')} AS away_win FROM i""")(
    lambda spark, sf: _odds(spark, sf).select("match_id", P.prices("odds_prob_home", "odds_prob_draw", "odds_prob_away").alias("p"))
    .select("match_id", "p.home_win", "p.draw", "p.away_win"))


def _elo_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 with its fallback: ratings before the last 30 days, and the initial rating for unknown sides."""
    hist, fx = SC.split_history(spark, sf_dir)
    out = EL.elo_asof(SC.with_hard_cases(fx), EL.elo_history(hist))
    return out.select("match_id", *(F.round(c, 6).alias(c) for c in ("home_elo", "away_elo", "elo_diff")))


_CUT = ", cut AS (SELECT CAST(max(match_date) - INTERVAL 30 DAY AS DATE) AS d FROM c)"
C.register("elo_asof", "J3", "WITH RECURSIVE " + O.CONTESTS + "," + O.ELO + _CUT + """,
ev AS (SELECT c.div, c.home_team AS team, c.match_date, c.match_id, e.home_elo_post AS rating FROM c JOIN elo e USING (match_id)
       UNION ALL SELECT c.div, c.away_team, c.match_date, c.match_id, e.away_elo_post FROM c JOIN elo e USING (match_id)),
lastr AS (SELECT div, team, rating FROM (SELECT *, row_number() OVER (PARTITION BY div, team ORDER BY match_date DESC, match_id DESC) AS k
  FROM ev WHERE match_date <= (SELECT d FROM cut)) WHERE k = 1),
fx0 AS (SELECT * FROM c WHERE match_date > (SELECT d FROM cut)),
fx AS (SELECT match_id, div, CASE WHEN match_id % 11 = 0 THEN 'X' || home_team ELSE home_team END AS home_team,
  CASE WHEN match_id % 13 = 0 THEN CASE WHEN match_id % 11 = 0 THEN 'X' || home_team ELSE home_team END
       WHEN match_id % 7 = 0 THEN 'Y' || away_team ELSE away_team END AS away_team FROM fx0)
SELECT fx.match_id, round(COALESCE(h.rating, 15e2), 6) AS home_elo, round(COALESCE(a.rating, 15e2), 6) AS away_elo,
  round(COALESCE(h.rating, 15e2) - COALESCE(a.rating, 15e2), 6) AS elo_diff
FROM fx LEFT JOIN lastr h ON h.div = fx.div AND h.team = fx.home_team LEFT JOIN lastr a ON a.div = fx.div AND a.team = fx.away_team""")(
    _elo_asof)


def _serving_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3's fill: the value, else the training median, else 0.0 (a column without any value, or without a median)."""
    rows = _odds(spark, sf_dir).withColumn("empty", F.lit(None).cast("double"))
    cols = ["odds_prob_home", "odds_prob_draw", "empty", "odds_fav_is_home"]
    medians = spark.read.parquet(SC.save_medians(spark, MD.exact_medians(rows, cols[:3]), "fill"))
    return SC.assemble(rows, medians, cols).select("match_id", *(F.round(c, 9).alias(c) for c in cols))


C.register("serving_fill", "B3", _ODDS + """, m AS (SELECT median(odds_prob_home) AS h, median(odds_prob_draw) AS d FROM i)
SELECT match_id, round(COALESCE(odds_prob_home, (SELECT h FROM m)), 9) AS odds_prob_home,
  round(COALESCE(odds_prob_draw, (SELECT d FROM m)), 9) AS odds_prob_draw, 0e0 AS empty,
  CAST(COALESCE(odds_fav_is_home, 0) AS DOUBLE) AS odds_fav_is_home FROM i""")(_serving_fill)


# ---------------------------------------------------------------- model board and run history over rule pickers
def _picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, split, target, predicted) of three pickers: the bookmaker's favourite, the higher rating, always home."""
    c = _split(spark, sf_dir)
    rated = c.join(EL.elo_history(c).select("match_id", "home_elo", "away_elo"), "match_id")
    rated = rated.withColumns({e: x for e, x in zip(["odds_prob_home", "odds_prob_draw", "odds_prob_away"], P.implied_probabilities())})
    pickers = F.array(
        F.struct(F.lit("bookmaker").alias("model"), P.bookmaker_pick().alias("predicted")),
        F.struct(F.lit("elo").alias("model"), F.when(F.col("home_elo") >= F.col("away_elo"), "H").otherwise("A").alias("predicted")),
        F.struct(F.lit("home").alias("model"), F.lit("H").alias("predicted")))
    return rated.select("split", F.col("ftr").alias("target"), F.explode(pickers).alias("p")).select("p.model", "split", "target", "p.predicted")


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MT.board(_picks(spark, sf_dir), baseline="bookmaker")


_BOARD = "WITH RECURSIVE " + O.CONTESTS + "," + O.ELO + """,
ix AS (SELECT *, row_number() OVER (ORDER BY match_date, match_id) - 1 AS idx, COUNT(*) OVER () AS n FROM c),
sp AS (SELECT ix.match_id, ftr, CASE WHEN idx < CAST(floor(n * 8e-1) AS BIGINT) THEN 'train' ELSE 'test' END AS split, """ + O.odds_cols() + """ FROM ix),
pk AS (SELECT sp.split, ftr AS target, u.model, CASE u.model WHEN 'home' THEN 'H'
    WHEN 'elo' THEN CASE WHEN e.home_elo >= e.away_elo THEN 'H' ELSE 'A' END
    ELSE CASE WHEN odds_prob_home IS NULL THEN NULL WHEN odds_prob_home >= odds_prob_draw AND odds_prob_home >= odds_prob_away THEN 'H'
         WHEN odds_prob_draw >= odds_prob_away THEN 'D' ELSE 'A' END END AS predicted
  FROM sp JOIN elo e USING (match_id), (VALUES ('bookmaker'), ('elo'), ('home')) u(model)),
acc AS (SELECT model, round(avg(CAST(COALESCE(predicted = target, FALSE) AS DOUBLE)) FILTER (WHERE split = 'train'), 9) AS train_accuracy,
    round(avg(CAST(COALESCE(predicted = target, FALSE) AS DOUBLE)) FILTER (WHERE split = 'test'), 9) AS test_accuracy FROM pk GROUP BY model),
board AS (SELECT *, round(train_accuracy - test_accuracy, 9) AS overfit_gap,
    round(test_accuracy - (SELECT test_accuracy FROM acc WHERE model = 'bookmaker'), 9) AS lift,
    CAST(row_number() OVER (ORDER BY test_accuracy DESC, model) AS INTEGER) AS place FROM acc)"""

C.register("model_board", "A12,O8,O10,M8,M12", _BOARD + " SELECT *, place = 1 AS best FROM board")(_board)


def _run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs appended to one table (the second knows the training part only), compared model by model."""
    path = fresh_path(spark, "runs")
    board = _board(spark, sf_dir).select("model", "train_accuracy", "test_accuracy")
    MT.append_run(board.select("model", F.col("train_accuracy").alias("accuracy")), path, 1)
    MT.append_run(board.select("model", F.col("test_accuracy").alias("accuracy")), path, 2)
    return MT.compare_runs(spark.read.parquet(path), 1, 2)


C.register("run_history", "M11", _BOARD + """
SELECT model, train_accuracy AS accuracy_1, test_accuracy AS accuracy_2, round(test_accuracy - train_accuracy, 9) AS difference,
  row_number() OVER (ORDER BY greatest(train_accuracy, test_accuracy) DESC, model) = 1 AS champion FROM board""")(_run_history)

C.register("recent_bounded", "O9,O1", O.with_(O.CONTESTS) + """
SELECT match_id, match_date, home_team, away_team FROM c ORDER BY match_date DESC, match_id DESC LIMIT 50""")(
    lambda spark, sf: contests(spark, sf).select("match_id", "match_date", "home_team", "away_team")
    .orderBy(F.desc("match_date"), F.desc("match_id")).limit(H.bounded(50)))


# ---------------------------------------------------------------- team windows over narrow blocks, same statements
def _blocked(name: str, groups: list[str]):
    columns = C._GROUP_COLS[name][0] if name in C._GROUP_COLS else [f"form5_{m}" for m in C.FORM_METRICS]
    C.register(f"{name}_blocked", C.IDS[name], C.SQL[name])(
        lambda spark, sf: FE.side_features(spark, sf, groups, width=40).select("match_id", "team", "is_home", *columns))


for _name in ("form5", "streaks", "season_stats", "h2h_features"):
    _blocked(_name, ["form"] if _name == "form5" else C._GROUP_COLS[_name][1])

C.register("live_table_short_blocks", "W9", C.SQL["live_table"])(lambda spark, sf: live_positions(contests(spark, sf), days=5))

C.register("sliding_avg_stream", "R1", C.SQL["sliding_avg"])(SR.sliding_averages_stream)
C.register("value_moves_stream", "R3", C.SQL["value_moves"])(SR.value_moves_streamed)
