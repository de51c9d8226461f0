"""Calendar column functions (F3, F4, F5): all built-in expressions, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A season starts on 1 August; dates from January to July belong to the
# season that started the previous year.
SEASON_START_MONTH = 8
SEASON_START_DAY = 1


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def season_year(d) -> Column:
    """Calendar year in which the season of ``d`` started."""
    d = _c(d)
    return F.year(d) - F.when(F.month(d) < SEASON_START_MONTH, 1).otherwise(0)


def season_start(d) -> Column:
    """1 August of the season's first year."""
    return F.make_date(season_year(d), F.lit(SEASON_START_MONTH), F.lit(SEASON_START_DAY))


def season_label(d) -> Column:
    """label such as ``2017-18``."""
    y = season_year(d)
    return F.concat(y.cast("string"), F.lit("-"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))


def day_of_week(d) -> Column:
    """Monday = 0 … Sunday = 6 (pandas ``dayofweek``), not Spark's Sunday-first ``dayofweek``."""
    return F.weekday(_c(d))


def is_weekend(d) -> Column:
    return (day_of_week(d) >= 5).cast("int")


def matchweek(d) -> Column:
    """``max(1, days since season start // 7)``."""
    days = F.datediff(_c(d), season_start(d))
    return F.greatest(F.lit(1), F.floor(days / 7).cast("int"))


def temporal_columns(d="match_date") -> list[Column]:
    """The four calendar features of a contest date."""
    return [day_of_week(d).alias("day_of_week"), F.month(_c(d)).alias("month"),
            is_weekend(d).alias("is_weekend"), matchweek(d).alias("matchweek")]
