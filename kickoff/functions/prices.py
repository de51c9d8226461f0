"""Price and probability column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default bookmaker margin applied when turning probabilities into prices.
DEFAULT_MARGIN = 0.05


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_divide(num, den, default: float = 0.0) -> Column:
    """``num/den``; a null or zero denominator gives ``default``; a null numerator stays null."""
    num, den = _c(num), _c(den)
    return (F.when(num.isNull(), F.lit(None).cast("double"))
            .when(den.isNull() | (den == 0), F.lit(default))
            .otherwise(num / den))


def implied_probabilities(h="b365h", d="b365d", a="b365a") -> list[Column]:
    """overround-free implied probabilities from three decimal prices.

    Any missing (or non-positive) price nulls all five outputs.
    """
    h, d, a = _c(h), _c(d), _c(a)
    ok = h.isNotNull() & d.isNotNull() & a.isNotNull() & (h > 0) & (d > 0) & (a > 0)
    ih, id_, ia = F.lit(1.0) / h, F.lit(1.0) / d, F.lit(1.0) / a
    total = ih + id_ + ia
    ph, pd_, pa = ih / total, id_ / total, ia / total
    null = F.lit(None).cast("double")
    return [F.when(ok, ph).otherwise(null).alias("odds_prob_home"),
            F.when(ok, pd_).otherwise(null).alias("odds_prob_draw"),
            F.when(ok, pa).otherwise(null).alias("odds_prob_away"),
            F.when(ok, ph - pa).otherwise(null).alias("odds_home_away_diff"),
            F.when(ok, (ph > pa).cast("int")).alias("odds_fav_is_home")]


def prob_to_price(p, margin: float = DEFAULT_MARGIN) -> Column:
    """F8: decimal price with margin, rounded to cents; ``p <= 0`` gives +inf.

    Spark rounds HALF_UP on the decimal text of the double (documented difference from
    Python's binary rounding; not emulated).
    """
    p = _c(p)
    return (F.when(p <= 0, F.lit(float("inf")))
            .otherwise(F.round(F.lit(1.0) / (p * F.lit(1.0 + margin)), 2)))


def prices(ph, pd_, pa, margin: float = DEFAULT_MARGIN) -> Column:
    """struct of three prices."""
    return F.struct(prob_to_price(ph, margin).alias("home_win"),
                    prob_to_price(pd_, margin).alias("draw"),
                    prob_to_price(pa, margin).alias("away_win"))


def value_edge(model_p, book_p) -> Column:
    """model minus bookmaker probability; a missing side gives 0.0."""
    return F.coalesce(_c(model_p) - _c(book_p), F.lit(0.0))


def is_value_bet(model_p, book_p, threshold: float = 0.0) -> Column:
    """strict ``edge > threshold``."""
    return value_edge(model_p, book_p) > F.lit(threshold)


def confidence(max_p, recency_days=None, h2h_played=None) -> Column:
    """``clip(pmax - min(days/365, 0.2) + min(0.01*h2h, 0.05), 0, 1)``."""
    days = F.lit(0) if recency_days is None else _c(recency_days)
    h2h = F.lit(0) if h2h_played is None else _c(h2h_played)
    raw = (_c(max_p) - F.least(days / F.lit(365.0), F.lit(0.2))
           + F.least(h2h * F.lit(0.01), F.lit(0.05)))
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def bookmaker_pick(ph="odds_prob_home", pd_="odds_prob_draw", pa="odds_prob_away") -> Column:
    """arg-max of the three implied probabilities; ties go home, then draw; nulls skipped."""
    ph, pd_, pa = _c(ph), _c(pd_), _c(pa)
    top = F.greatest(ph, pd_, pa)
    return (F.when(top.isNull(), F.lit(None).cast("string"))
            .when(ph == top, "H").when(pd_ == top, "D").otherwise("A"))


def argmax_label(p_a, p_d, p_h) -> Column:
    """label of the largest class probability, classes in alphabetical order A, D, H
    (first maximum wins, as numpy ``argmax``)."""
    p_a, p_d, p_h = _c(p_a), _c(p_d), _c(p_h)
    top = F.greatest(p_a, p_d, p_h)
    return F.when(p_a == top, "A").when(p_d == top, "D").otherwise("H")
