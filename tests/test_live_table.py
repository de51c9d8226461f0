"""The live table does not depend on how a season is cut into blocks."""

from contest_samples import SF_SMALL

import kickoff.operators.league as league
from kickoff.sources.contests import contests


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_blocks_of_any_length_agree(spark, monkeypatch):
    c = contests(spark, SF_SMALL)
    whole = rows(league.live_positions(c))
    assert league.block_days(c) == league.SEASON_DAYS
    for days in (5, 28, 1 << 20):
        assert rows(league.live_positions(c, days)) == whole
    monkeypatch.setattr(league, "BLOCK_CONTESTS", 3)
    assert 1 <= league.block_days(c) < league.SEASON_DAYS
    assert rows(league.live_positions(c)) == whole
