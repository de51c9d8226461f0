"""Registered queries vs their DuckDB oracles on the smallest scale, plus plan-shape checks."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from contest_samples import SF_SMALL

import __spark_entry__ as E
from oracle_check import TABLES, rows

# quick, SQL-checked queries covering every operator family
FAST = ["team_long", "form5", "exp_form", "venue_form", "streaks", "season_stats", "shooting", "h2h_features",
        "all_features", "model_ready", "implied_probs", "temporal", "prob_to_odds", "bookmaker_pick",
        "elo_history", "elo_current", "team_record", "h2h_summary", "h2h_recent", "recent_form", "recent_matches",
        "clean_contests", "dq_report", "dedup_contests", "contract_quarantine", "time_split", "time_folds",
        "rest_days", "live_table", "feature_corr", "anova_outcome", "class_report", "log_loss", "value_bets",
        "bet_profit", "fixture_accept", "sliding_avg", "value_moves", "rolling_48h", "psi_drift", "auc_ovr",
        "standings_long", "season_scan", "ingest_pipeline", "asof_state", "elo_stream", "route_events",
        "model_ready_leaky", "league_position", "accuracy_by_month", "fixture_reject", "contract_valid",
        "dq_report_missing_columns", "label_encode", "scaler_stats", "train_medians", "safe_divide", "argmax_pick", "price_struct",
        "elo_asof", "serving_fill", "model_board", "run_history", "form5_blocked", "streaks_blocked", "season_stats_blocked",
        "h2h_features_blocked"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_registry_is_consistent():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 83


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    sp = E.queries()[name](spark, SF_SMALL).toPandas()
    dd = duck.execute(E.oracle_sql()[name]).df()
    c1, r1 = rows(sp)
    c2, r2 = rows(dd)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "home_elo" in df.columns and "target" in df.columns


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _nodes(node):
    """All physical operators of a plan, below adaptive wrappers and scalar subqueries too."""
    yield node
    kids = [node.inputPlan()] if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else []
    for group in (node.children(), node.subqueries()):
        kids += [group.apply(i) for i in range(group.size())]
    for kid in kids:
        yield from _nodes(kid)


@pytest.mark.parametrize("name", ["all_features", "form5", "streaks", "team_record", "h2h_recent", "dq_report", "dedup_contests",
                                  "rolling_48h", "value_moves", "live_table", "elo_history", "clean_contests", "rest_days",
                                  "streaks_blocked", "sliding_avg", "elo_asof"])
def test_no_cartesian_or_unpartitioned_window(spark, name):
    for node in _nodes(E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan()):
        kind = node.getClass().getSimpleName()
        assert kind not in ("CartesianProductExec", "BroadcastNestedLoopJoinExec"), name
        if kind.startswith("Window") and kind != "WindowGroupLimitExec":
            assert node.partitionSpec().size() > 0, f"window without a partition key in {name}"


@pytest.mark.parametrize("name", ["all_features", "dedup_contests"])
def test_wide_rows_are_not_aggregated_by_sorting(spark, name):
    kinds = [n.getClass().getSimpleName() for n in _nodes(E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan())]
    assert "SortAggregateExec" not in kinds


def test_short_and_old_dates(spark):
    from kickoff.operators.quality import parse_day_first

    texts = ["1/9/2002", "16/08/93", "01/02/03", "7/7/68", "7/7/69", " 5/12/1999 ", "31/2/2001", "x", "", None, "2002-09-01", "1/9/123"]
    got = [str(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "d string").select(parse_day_first("d")).collect()]
    assert got == ["2002-09-01", "1993-08-16", "2003-02-01", "2068-07-07", "1969-07-07", "1999-12-05"] + ["None"] * 6


def test_strict_validation_and_bounds(spark):
    from kickoff.operators import history as H
    from kickoff.operators.quality import out_of_order, validate
    from kickoff.sources.contests import contests

    clean = contests(spark, SF_SMALL).dropDuplicates(["match_date", "home_team", "away_team"])
    with pytest.raises(ValueError, match="missing_column ftr"):
        validate(clean.drop("ftr"), strict=True)
    assert validate(clean).count() > 0
    rows = spark.createDataFrame([(1, 3), (2, 1), (3 << 20, 2), (5 << 40, 1), (5 << 40 | 1, 9)], "match_id long, d int")
    rows = rows.selectExpr("match_id", "date_add(date'2000-01-01', d) as match_date")
    assert out_of_order(rows).first()[0] == 2 and out_of_order(rows, bits=3).first()[0] == 2
    for limit in (0, 51):
        with pytest.raises(ValueError):
            H.recent_matches(clean, limit)


def test_stream_of_old_contests_raises_and_scratch_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    import pandas as pd

    from kickoff import session
    from kickoff.streaming import jobs

    fold = jobs._elo_update()
    state = SimpleNamespace(exists=False, get=(None,), update=lambda v: (setattr(state, "get", v), setattr(state, "exists", True)))
    day = lambda d: pd.DataFrame({"match_id": [1], "div": ["L"], "match_date": [d], "home_team": ["a"], "away_team": ["b"],
                                  "score": [1.0], "stake": [20.0]})
    assert len(list(fold(("L",), iter([day("2001-01-02")]), state))) == 1
    with pytest.raises(ValueError, match="out of date order"):
        list(fold(("L",), iter([day("2001-01-01")]), state))
    fake = SimpleNamespace(sparkContext=SimpleNamespace(
        getCheckpointDir=lambda: None, master="yarn", getConf=lambda: SimpleNamespace(get=lambda *a: None)),
        conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(fake)


def test_feature_plan_has_one_big_shuffle(spark):
    """All team windows share one exchange on (div, team, block); the pivot is one more."""
    from kickoff.plans.features import side_features

    p = _plan(side_features(spark, SF_SMALL))
    assert p.count("Exchange hashpartitioning(div") == 1
    assert p.count("Sort [") <= 3


def test_scan_prunes_columns(spark):
    from kickoff.plans.features import side_features

    p = side_features(spark, SF_SMALL, ["form"])._jdf.queryExecution().executedPlan().toString()
    scans = [l for l in p.splitlines() if "FileScan parquet" in l]
    assert scans and all("o_totalprice" not in l for l in scans)


def test_medians_exact(spark, monkeypatch):
    from kickoff.operators import medians as M
    from kickoff.operators import order_stats as OS

    data = pd.DataFrame({"a": [1.0, 2.0, 2.0, 3.0, 10.0, None], "b": [5, 5, 5, 1, 9, 7]})
    df = spark.createDataFrame(data)
    got = M.exact_medians(df, ["a", "b"])
    assert got["a"] == 2.0 and got["b"] == 5.0
    big = spark.range(0, 100001).selectExpr("cast((id * 7919) % 100001 as double) as x", "cast(id % 3 as double) as y")
    for listed, step in ((100, 12), (0, 5)):  # force refinement passes and coarse sections
        monkeypatch.setattr(OS, "LISTED", listed)
        monkeypatch.setattr(OS, "STEP", step)
        skewed = big.selectExpr("x", "y", "if(x < 3, 1e300, x) as far", "if(x < 50001, 0, x) as low",
                                "if(x < 50000, -1e9, 1e9) as gap", "cast(null as double) as none", "if(x > 9, double('nan'), x) as few")
        got = M.exact_medians(skewed, skewed.columns)
        assert got == {"x": 50000.0, "y": 1.0, "far": 50003.0, "low": 0.0, "gap": 1e9, "none": None, "few": 4.5}


def test_p_values():
    from kickoff.operators.stats import reg_inc_beta

    # two-sided p of r = 0.5 with n = 10 (t = 1.633, 8 df) is 0.1411
    df, r = 8.0, 0.5
    t2 = r * r * df / (1 - r * r)
    p = float(reg_inc_beta(df / 2, 0.5, df / (df + t2)))
    assert p == pytest.approx(0.14111, abs=5e-4)


def test_price_functions(spark):
    from pyspark.sql import functions as F

    from kickoff.functions import prices as P

    df = spark.createDataFrame([(0.45, 0.40), (0.0, 0.5), (None, 0.3)], "p double, b double")
    r = df.select(P.prob_to_price("p").alias("price"), P.value_edge("p", "b").alias("edge"),
                  P.is_value_bet("p", "b", 0.05).alias("vb")).collect()
    assert r[0].price == 2.12 and math.isinf(r[1].price)
    assert r[0].edge == pytest.approx(0.05) and r[0].vb is False  # strict threshold
    assert r[2].edge == 0.0
    c = df.select(P.confidence(F.lit(0.9), F.lit(400), F.lit(10)).alias("c")).first().c
    assert c == pytest.approx(0.9 - 0.2 + 0.05)


def test_calendar_functions(spark):
    import datetime as dt

    from kickoff.functions import calendar as C

    df = spark.createDataFrame([(dt.date(2017, 9, 16),), (dt.date(2018, 3, 4),)], "d date")
    r = df.select(C.season_label("d").alias("s"), C.day_of_week("d").alias("w"), C.is_weekend("d").alias("we"),
                  C.matchweek("d").alias("mw")).collect()
    assert [x.s for x in r] == ["2017-18", "2017-18"]
    assert (r[0].w, r[0].we) == (5, 1)  # Saturday, Monday = 0
    assert r[0].mw == 6


def test_correlations_of_many_columns_are_vectorised_moments(spark):
    """No aggregation with a buffer a column: batches are reduced by column, and parts merge to the same r."""
    from kickoff.operators import stats as ST

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(3, 900)) * 100 + 1500, rng.integers(-1, 2, 900)
    rows = [(*(None if (i + k) % 7 == 0 else float(v) for k, v in enumerate(x[:, i])), None, None if i % 11 == 0 else int(y[i])) for i in range(900)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, target_num int").repartition(5)
    out = ST.correlations(df, ["a", "b", "c", "d"], digits=None)
    assert "corr(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["feature"]: (r["n"], r["r"]) for r in out.collect()}
    for k, c in enumerate("abc"):
        both = [i for i in range(900) if (i + k) % 7 and i % 11]
        assert got[c][0] == len(both) and got[c][1] == pytest.approx(np.corrcoef(x[k, both], y[both])[0, 1], rel=1e-10)
    assert got["d"] == (0, None)
    assert {(r["feature"], r["n"], r["r"]) for r in ST.correlations(df.limit(0), ["a", "b"]).collect()} == {("a", 0, None), ("b", 0, None)}
