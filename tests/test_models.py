"""The registered model queries cover every model, and the value edge uses the quoted prices."""

import pytest
from contest_samples import SF_SMALL

import __spark_entry__ as E
from kickoff.plans import scoring as SC
from kickoff.plans import training as TR

ALL = {"Logistic Regression", "Random Forest", "Gradient Boosting", "Second-order Boosting"}


@pytest.fixture()
def few_trees(monkeypatch):
    """Small ensembles: the tests look at which models run and what comes out, not at their quality."""
    monkeypatch.setitem(TR.FOREST, "numTrees", 2)
    monkeypatch.setitem(TR.FOREST, "maxDepth", 2)
    for model in (TR.BOOSTING, TR.SECOND_ORDER):
        monkeypatch.setitem(model, "rounds", 2)
        monkeypatch.setitem(model, "depth", 2)


def test_boards_and_cv_cover_all_models(spark, few_trees):
    assert {r["model"] for r in E.queries()["train_models"](spark, SF_SMALL).collect()} == ALL
    cv = E.queries()["cv_scores"](spark, SF_SMALL).collect()
    assert {r["model"] for r in cv} == ALL and all(len(r["folds"]) == 5 for r in cv)
    assert ALL <= set(E.queries()["compare_versions"](spark, SF_SMALL).columns)


def test_batch_predict_uses_the_selected_model_and_quoted_prices(spark, few_trees, monkeypatch):
    chosen = []
    real = TR.select_model
    monkeypatch.setattr(TR, "select_model", lambda *a: chosen.append((real(*a), {m.name for m in a[1]})) or chosen[-1][0])
    got = {r["match_id"]: r for r in E.queries()["batch_predict"](spark, SF_SMALL).collect()}
    assert chosen[0][1] == ALL
    quoted = {r["match_id"]: r for r in SC.contests(spark, SF_SMALL).collect()}
    for i, r in got.items():
        h, d, a = (quoted[i][c] for c in ("b365h", "b365d", "b365a"))
        edge = 0.0 if h is None else r["prob_home_win"] - 1 / h / (1 / h + 1 / d + 1 / a)
        assert r["value_home"] == pytest.approx(edge)
    assert any(r["value_home"] for r in got.values())


def test_a_forest_keeps_the_nodes_of_its_rows_while_they_are_small(spark, monkeypatch):
    rows = spark.range(600).selectExpr("cast(id % 3 as double) label", "cast(id % 3 + id % 7 as double) a", "cast(id * 31 % 17 as double) b")
    kept, trees = [], []
    real = TR.RandomForestClassifier
    monkeypatch.setattr(TR, "RandomForestClassifier", lambda **p: kept.append(p["cacheNodeIds"]) or real(**p))
    for most in (1 << 29, 1000):
        monkeypatch.setattr(TR, "NODE_ID_BYTES", most)
        trees.append(TR.fit_forest(rows, ["a", "b"], numTrees=3, maxDepth=4).models[0].toDebugString.split("\n", 1)[1])
    assert kept == [True, False] and trees[0] == trees[1]
