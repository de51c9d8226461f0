"""Point-in-time features on the reference's 12-row fixture (hand-computed values, FIXTURES §1a)."""

import math

import pytest
from contest_samples import SF_SMALL, sample_contests
from pyspark.sql import functions as F

from kickoff.operators.perspective import team_long
from kickoff.operators.team_windows import team_features
from kickoff.plans import features as FE
from kickoff.session import materialize

ONE_BLOCK = 1 << 20


def _side(df, match_id, team):
    return df.where((F.col("match_id") == match_id) & (F.col("team") == team)).first().asDict()


@pytest.fixture(scope="module")
def feats(sample):
    return team_features(team_long(sample), ONE_BLOCK).cache()


def test_team_long_mirrors_every_contest(sample):
    tl = team_long(sample)
    assert tl.count() == 24
    r = tl.where((F.col("match_id") == 3) & (F.col("team") == "Arsenal")).first()
    assert (r.is_home, r.gf, r.ga, r.result, r.points, r.shots_for) == (False, 1, 1, "D", 1, 12)


def test_form_before_november(feats):
    # Arsenal's 2023-11-04 contest sees the six earlier ones: W D W D L D; last five D W D L D
    f = _side(feats, 9, "Arsenal")
    assert f["form5_points"] == 6
    assert f["form5_win_rate"] == pytest.approx(0.2)
    assert f["form5_goal_diff"] == 0
    assert f["form5_avg_goals_for"] == pytest.approx(1.4)
    assert f["form3_points"] == 2 + 0 and f["form10_points"] == 3 + 1 + 3 + 1 + 0 + 1


def test_exponential_form(feats):
    f = _side(feats, 9, "Arsenal")
    assert f["exp_form"] == pytest.approx(2.7591 / 2.7731, abs=1e-9)


def test_streaks(feats):
    f = _side(feats, 9, "Arsenal")
    assert (f["win_streak"], f["unbeaten_streak"], f["loss_streak"]) == (0, 1, 0)
    for r in feats.collect():
        assert r.unbeaten_streak >= r.win_streak
        assert not (r.win_streak > 0 and r.loss_streak > 0)


def test_venue_form(feats):
    f = _side(feats, 9, "Arsenal")  # Arsenal at home before: W W D
    assert f["venue_win_rate"] == pytest.approx(2 / 3)
    assert f["venue_clean_sheets"] == 0


def test_empty_history_defaults(feats):
    f = _side(feats, 1, "Arsenal")
    assert f["form5_points"] is None and f["exp_form"] is None and f["venue_win_rate"] is None
    assert (f["win_streak"], f["season_played"], f["h2h_played"]) == (0, 0, 0)
    assert f["season_win_rate"] is None and f["h2h_win_rate"] is None


def test_head_to_head_both_orientations(spark):
    # a probe contest on 2024-01-01 sees the four earlier Arsenal–Chelsea meetings: 2-1, 1-1, 2-2, 3-0
    probe = [("2024-01-01", "Arsenal", "Chelsea", 0, 0, "D", 1, 1, 1, 1, 2.0, 3.0, 4.0)]
    f = team_features(team_long(sample_contests(spark, probe)), ONE_BLOCK)
    r = _side(f, 13, "Arsenal")
    assert r["h2h_played"] == 4
    assert r["h2h_win_rate"] == pytest.approx(0.5)
    assert r["h2h_avg_gf"] == pytest.approx(2.0)
    c = _side(f, 13, "Chelsea")
    assert c["h2h_played"] == 4 and c["h2h_win_rate"] == 0.0  # symmetric count, Chelsea's view


def test_shooting_bounds(feats):
    for r in feats.collect():
        if r.shot_accuracy is not None:
            assert 0.0 <= r.shot_accuracy <= 1.0
            assert r.avg_shots > 0


def test_season_played_monotone_within_season(feats):
    rows = sorted((r for r in feats.collect() if r.team == "Liverpool"), key=lambda r: (r.match_date, r.match_id))
    played = [r.season_played for r in rows]
    assert played == sorted(played)


def test_no_leakage_from_future_rows(spark, sample):
    """Appending later contests never changes the features of earlier ones."""
    later = [("2024-01-06", "Chelsea", "Liverpool", 5, 0, "H", 20, 2, 9, 1, 1.5, 4.0, 6.0),
             ("2024-01-13", "Arsenal", "Liverpool", 0, 4, "A", 3, 20, 1, 9, 1.7, 3.8, 5.0)]
    cols = ["match_id", "team", "form5_points", "exp_form", "win_streak", "season_win_rate", "h2h_win_rate",
            "venue_win_rate", "avg_shots"]
    a = {(r.match_id, r.team): r for r in team_features(team_long(sample), ONE_BLOCK).select(*cols).collect()}
    b = {(r.match_id, r.team): r for r in
         team_features(team_long(sample_contests(spark, later)), ONE_BLOCK).select(*cols).collect()}
    for k, r in a.items():
        assert b[k] == r


def test_same_day_rows_do_not_see_each_other(spark):
    # two Arsenal contests on one day: the second must not see the first
    extra = [("2023-12-09", "Arsenal", "Chelsea", 3, 0, "H", 10, 5, 5, 2, 1.5, 4.0, 6.0),
             ("2023-12-09", "Liverpool", "Arsenal", 0, 0, "D", 10, 5, 5, 2, 1.5, 4.0, 6.0)]
    f = team_features(team_long(sample_contests(spark, extra)), ONE_BLOCK)
    a, b = _side(f, 13, "Arsenal"), _side(f, 14, "Arsenal")
    for k in ("form5_points", "exp_form", "win_streak", "season_played", "avg_shots"):
        assert a[k] == b[k]


def test_blocked_windows_equal_single_block(spark):
    """Time blocks with halos and block offsets give exactly the one-block answers."""
    from kickoff.sources.contests import contests

    tl = team_long(contests(spark, SF_SMALL))
    cols = ["form3_points", "form10_win_rate", "exp_form", "venue_clean_sheets", "win_streak", "unbeaten_streak",
            "season_played", "season_ppg", "shot_conversion", "h2h_played", "h2h_avg_gf", "rest_days"]
    one = {(r.match_id, r.team): r for r in team_features(tl, ONE_BLOCK).select("match_id", "team", *cols).collect()}
    many = {(r.match_id, r.team): r for r in team_features(tl, 40).select("match_id", "team", *cols).collect()}
    assert one.keys() == many.keys()
    bad = [k for k in one if one[k] != many[k]]
    assert not bad, bad[:3]


@pytest.mark.parametrize("inclusive", [False, True])
def test_cuts_of_the_stream_do_not_change_the_features(spark, monkeypatch, inclusive):
    """A key whose rows come in many chunks, with and without time blocks, has the features of one chunk."""
    from kickoff.operators import team_sums
    from kickoff.sources.contests import contests

    tl = team_long(contests(spark, SF_SMALL)).cache()
    whole = sorted(map(str, team_features(tl, ONE_BLOCK, inclusive=inclusive).collect()))
    monkeypatch.setattr(team_sums, "CHUNK", 5)
    for width in (ONE_BLOCK, 40):
        assert sorted(map(str, team_features(tl, width, inclusive=inclusive).collect())) == whole


def test_team_features_are_one_sorted_stream(spark):
    """No window operator buffers the rows of a team: one exchange, one sort, one stream."""
    from kickoff.plans.features import side_features

    plan = side_features(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Window [" not in plan and plan.count("Sort [") == 1 and plan.count("MapInArrow") == 1


def test_elo_zero_sum_and_initial(spark, sample):
    from kickoff.operators.elo import elo_current, elo_history

    h = elo_history(sample).orderBy("match_date", "match_id").collect()
    assert (h[0].home_elo, h[0].away_elo) == (1500.0, 1500.0)
    for r in h:
        assert (r.home_elo_post - r.home_elo) + (r.away_elo_post - r.away_elo) == pytest.approx(0.0, abs=1e-9)
    cur = {r.team: r.rating for r in elo_current(elo_history(sample)).collect()}
    assert sum(cur.values()) == pytest.approx(4500.0)


def test_elo_larger_k_moves_more(spark, sample):
    from kickoff.operators.elo import elo_history

    a = elo_history(sample, k=20).where("match_id = 1").first()
    b = elo_history(sample, k=40).where("match_id = 1").first()
    assert abs(b.home_elo_post - 1500) > abs(a.home_elo_post - 1500)


def test_elo_asof_for_fixtures(spark, sample):
    from kickoff.operators.elo import elo_asof, elo_current, elo_history

    h = elo_history(sample)
    fx = spark.createDataFrame([(100, "E0", "Arsenal", "Chelsea", "2024-02-01"), (101, "E0", "Newcomer", "Arsenal", "2023-08-01")],
                               "match_id long, div string, home_team string, away_team string, d string") \
        .withColumn("match_date", F.to_date("d"))
    got = {r.match_id: r for r in elo_asof(fx, h).collect()}
    cur = {r.team: r.rating for r in elo_current(h).collect()}
    assert got[100].home_elo == pytest.approx(cur["Arsenal"]) and got[100].away_elo == pytest.approx(cur["Chelsea"])
    assert got[101].home_elo == 1500.0 and got[101].away_elo == 1500.0  # before any history: initial


def test_match_features_wide(spark):
    from kickoff.plans.features import MODEL_FEATURES, match_features

    mf = match_features(spark, SF_SMALL)
    assert mf.count() == mf.select("match_id").distinct().count()
    assert set(MODEL_FEATURES) <= set(mf.columns)
    r = mf.where(F.col("home_form5_points").isNotNull() & F.col("away_form5_points").isNotNull()).first()
    assert r.diff_form5_points == r.home_form5_points - r.away_form5_points
    assert not math.isnan(r.elo_diff)


def test_a_task_of_the_windows_holds_blocks_of_a_hot_team_not_its_history(spark):
    from pyspark.sql import functions as F

    from kickoff.operators.blocked import block_width, dealt, single_block

    hot = spark.range(240_000).select(F.lit("L").alias("div"), F.lit("T").alias("team"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 1000).cast("int")).alias("match_date"))
    width = block_width(hot, ["div", "team"])
    assert not single_block(width) and 300 <= width <= 500  # some 100,000 of 240,000 rows in 1000 days
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert dealt(hot, ["team"], 100_000 * (usual + 5)).rdd.getNumPartitions() == usual + 5


def test_model_ready_computes_only_the_columns_it_returns(spark, tmp_path, monkeypatch):
    """The written table holds no column that is dropped afterwards, and windows of others are not computed; fewer wanted features, same values."""
    written = []

    def keep(df, name):
        written.append(df)
        return materialize(df, name)

    k = F.col("id")
    spark.range(3000).select(k.alias("o_orderkey"), (k * 7 % 150).alias("o_custkey"), F.date_add(F.lit("1995-01-01").cast("date"), (k % 900).cast("int"))
                             .cast("timestamp").alias("o_orderdate")).write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(FE, "materialize", keep)
    features = FE.match_features(spark, str(tmp_path))
    whole, some = FE.model_ready(features), FE.model_ready(features, wanted=["diff_season_ppg", "odds_home_away_diff"])
    assert set(written[0].columns) == set(whole.columns)
    assert set(written[1].columns) == set(some.columns) == {*FE.META, "diff_season_ppg", "odds_home_away_diff", *FE.TARGETS}
    plan = written[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "form5_win_rate" in plan and "form10_win_rate" not in plan
    assert whole.count() > 1000
    assert sorted(map(tuple, whole.select(*some.columns).collect()), key=str) == sorted(map(tuple, some.collect()), key=str)
