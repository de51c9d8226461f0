"""Streams take their micro-batches in bounded pieces, keep state between them and refuse late rows."""

import datetime as dt
from types import SimpleNamespace

import pandas as pd
import pytest
from contest_samples import SF_SMALL

from kickoff.operators.elo import elo_history
from kickoff.sources.contests import contests
from kickoff.streaming import jobs as J
from kickoff.streaming import run as SR


def test_elo_update_takes_one_frame_at_a_time():
    """A frame's ratings come out before the next frame is asked for."""
    asked = []

    def frames():
        for day in ("2001-01-01", "2001-01-02"):
            asked.append(day)
            yield pd.DataFrame({"match_id": [1], "div": ["L"], "match_date": [day], "home_team": ["a"], "away_team": ["b"],
                                "score": [1.0], "stake": [20.0]})

    state = SimpleNamespace(exists=False, get=(None,), update=lambda v: None)
    out = J._elo_update()(("L",), frames(), state)
    next(out)
    assert asked == ["2001-01-01"]


def test_elo_carries_ratings_between_batches(spark, tmp_path):
    c = contests(spark, SF_SMALL)
    write = J.elo_batches(str(tmp_path))
    write(c.where("match_date < date'1998-04-13'"), 0)
    for _ in range(2):  # a replay changes nothing
        write(c.where("match_date >= date'1998-04-13'"), 1)
    cols = J.ELO_COLS
    got = spark.read.parquet(str(tmp_path)).where("match_id is not null").select(*cols).orderBy("match_id").toPandas()
    want = elo_history(c).select(*cols).orderBy("match_id").toPandas()
    pd.testing.assert_frame_equal(got, want)
    with pytest.raises(Exception, match="out of date order"):
        write(c.where("match_date < date'1998-04-13'"), 2)


def test_moves_split_a_hot_key_and_carry_state(spark, tmp_path, monkeypatch):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), 1, "x", float(i * 7 % 11) if i % 13 else None) for i in range(300)]
    e = spark.createDataFrame(rows, J.MOVE_SCHEMA)
    calls = []
    real = J.value_moves
    monkeypatch.setattr(J, "value_moves", lambda *a: calls.append(a) or real(*a))  # the plan that cuts a key into blocks
    write = J.move_batches(str(tmp_path))
    for epoch, (a, b) in enumerate([(0, 100), (100, 101), (101, 300)]):
        write(e.where(f"event_id >= {a} and event_id < {b}"), epoch)
    got = sorted(map(tuple, spark.read.schema(J.MOVE_OUT).parquet(f"{tmp_path}/moves").drop("epoch").collect()))
    assert got == sorted(map(tuple, real(e).collect())) and len(got) > 100 and len(calls) == 3
    with pytest.raises(ValueError, match="arrived after a later one"):
        write(e.where("event_id = 5"), 3)


def test_moves_are_fed_week_by_week(spark, monkeypatch):
    epochs = []
    real = J.move_batches
    monkeypatch.setattr(J, "move_batches", lambda d: lambda b, e: epochs.append(e) or real(d)(b, e))
    assert SR.value_moves_streamed(spark, SF_SMALL).exceptAll(J.value_moves(SR.events(spark, SF_SMALL))).count() == 0
    assert epochs == list(range(5))
