"""Key and label column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Result codes, their meaning from each side, points per outcome.
HOME_VIEW = {"H": "W", "D": "D", "A": "L"}
AWAY_VIEW = {"H": "L", "D": "D", "A": "W"}
POINTS = {"W": 3, "D": 1, "L": 0}
NUMERIC_TARGET = {"H": 1, "D": 0, "A": -1}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def result_code(home_goals, away_goals) -> Column:
    hg, ag = _c(home_goals), _c(away_goals)
    return F.when(hg > ag, "H").when(hg < ag, "A").when(hg == ag, "D")


def _lookup(c: Column, values: dict) -> Column:
    """The mapped value; null for anything else."""
    (first, out), *rest = values.items()
    chain = F.when(c == first, F.lit(out))
    for key, value in rest:
        chain = chain.when(c == key, F.lit(value))
    return chain


def side_result(ftr, is_home) -> Column:
    """H/D/A seen from one side → W/D/L."""
    return F.when(_c(is_home), _lookup(_c(ftr), HOME_VIEW)).otherwise(_lookup(_c(ftr), AWAY_VIEW))


def points(result) -> Column:
    return _lookup(_c(result), POINTS)


def numeric_target(ftr) -> Column:
    """H=1, D=0, A=-1."""
    return _lookup(_c(ftr), NUMERIC_TARGET)


def match_key(home, away, d) -> Column:
    """``home_vs_away_yyyyMMdd``."""
    return F.concat(_c(home), F.lit("_vs_"), _c(away), F.lit("_"), F.date_format(_c(d), "yyyyMMdd"))


def pair_key(a, b) -> list[Column]:
    """Canonical unordered pair (J2): ``least``/``greatest`` so either orientation is one equi-key."""
    return [F.least(_c(a), _c(b)).alias("pair_lo"), F.greatest(_c(a), _c(b)).alias("pair_hi")]
