"""Statistics for the EDA job.

Correlations of many columns are computed in ONE pass: every task adds up the moments of all columns in vectorised batches and sends
one row a column (an aggregation of 59 ``corr`` is too wide for generated code), and those are merged. p-values need the regularised incomplete beta function, which
Spark lacks: it is evaluated by a vectorised pandas UDF on the (tiny) result table, so the
work still runs on executors and nothing but the final rows reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

R_DIGITS = 6


def _rounded(c, digits: int | None):
    return c if digits is None else F.round(c, digits)


_MOMENTS = ("n", "x", "y", "xx", "yy", "xy")  # rows, means, and sums of squares and products around them


def _doubles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    there = column.is_valid().to_numpy(zero_copy_only=False)
    return column.fill_null(0.0).to_numpy(zero_copy_only=False), there


def _moments(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    if not len(x):
        return (0.0,) * 6
    dx, dy = x - x[0], y - y[0]  # equal values differ by nothing at all
    mx, my = dx.mean(), dy.mean()
    dx -= mx
    dy -= my
    return len(x), x[0] + mx, y[0] + my, dx @ dx, dy @ dy, dx @ dy


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of two sets of rows together (moments by columns)."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    dx, dy = (np.where((a[0] > 0) & (b[0] > 0), b[k] - a[k], 0.0) for k in (1, 2))
    between = a[0] * share
    return np.array([n, *(np.where(a[0] > 0, a[k] + d * share, b[k]) for k, d in ((1, dx), (2, dy))),
                     a[3] + b[3] + dx * dx * between, a[4] + b[4] + dy * dy * between, a[5] + b[5] + dx * dy * between])


def correlations(df: DataFrame, features: list[str], target: str = "target_num",
                 digits: int | None = R_DIGITS) -> DataFrame:
    """Pearson r of each feature with ``target`` over pairwise-complete rows.

    Returns ``(feature, n, r)``; ``r`` is rounded to ``digits`` (summation order differs between
    engines in the last bits); ``None`` keeps it as it is, as p-values need it.
    """
    session, width = df.sparkSession, len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((6, width))
        for batch in batches:
            y, has_y = _doubles(batch.column(width))
            parts = np.array([_moments(x[both], y[both]) for k in range(width) for x, has_x in [_doubles(batch.column(k))] for both in [has_x & has_y]])
            held = _merged(held, parts.T)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), *(pa.array(m, pa.float64()) for m in held)], ["i", *_MOMENTS])

    def merge(key: tuple, parts: pa.Table) -> pa.Table:
        held = np.zeros(6)
        for part in zip(*(parts.column(m).to_numpy() for m in _MOMENTS)):
            held = _merged(held[:, None], np.array(part)[:, None])[:, 0]
        return pa.table({"feature": [features[key[0].as_py()]], "n": pa.array([int(held[0])], pa.int64()),
                         **{m: pa.array([v], pa.float64()) for m, v in zip(_MOMENTS[3:], held[3:])}})

    plain = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate([*features, target])])
    moments = ", ".join(f"{m} double" for m in _MOMENTS)
    none = session.range(width, numPartitions=1).select(F.col("id").cast("int").alias("i"), *[F.lit(0.0).alias(m) for m in _MOMENTS])
    parts = plain.mapInArrow(run, f"i int, {moments}").unionAll(none)  # a feature has a row even where no task has any
    out = parts.groupBy("i").applyInArrow(lambda key, table: merge(key, table), "feature string, n long, xx double, yy double, xy double")
    r = F.when(F.col("n") > 1, F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))  # as corr: no variance is a division by zero
    return out.select("feature", "n", _rounded(r, digits).alias("r"))


def anova(df: DataFrame, value: str, group: str = "ftr", digits: int | None = R_DIGITS) -> DataFrame:
    """One-way ANOVA F of ``value`` across ``group`` levels (nulls dropped).

    Per-group ``count, sum, sum of squares`` in one pass; F from the between/within sums.
    """
    g = (df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
         .groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("double")).alias("s"),
                             F.sum(F.col(value).cast("double") * F.col(value).cast("double")).alias("q")))
    tot = g.agg(F.sum("n").alias("N"), F.sum("s").alias("S"), F.count(F.lit(1)).alias("k"),
                F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between_raw"), F.sum("q").alias("Q"))
    ssb = F.col("between_raw") - F.col("S") * F.col("S") / F.col("N")
    ssw = F.col("Q") - F.col("between_raw")
    return tot.select(F.lit(value).alias("feature"), (F.col("k") - 1).alias("df_between"),
                      (F.col("N") - F.col("k")).alias("df_within"),
                      _rounded((ssb / (F.col("k") - 1)) / (ssw / (F.col("N") - F.col("k"))), digits).alias("f_stat"))


def group_summary(df: DataFrame, value: str, group: str = "ftr") -> DataFrame:
    """A5: mean and exact median of ``value`` per outcome. ``median`` keeps one counter per
    distinct value; the inputs here (day and position differences) have a small bounded domain."""
    return (df.where(F.col(value).isNotNull()).groupBy(group)
            .agg(F.lit(value).alias("feature"), F.avg(value).alias("mean"), F.median(value).alias("median")))


def rank_by_abs(corrs: DataFrame, top: int = 20) -> DataFrame:
    """Order by |r| (desc) and keep the top ``top`` (the table has one row per feature)."""
    w = Window.orderBy(F.abs("r").desc(), "feature")
    return (corrs.where(F.col("r").isNotNull()).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= top))


# ------------------------------------------------------------------ p-values
def _fraction(a, b, x, depth: int):
    """1 / (1 + e1 / (1 + e2 / ...)) cut after ``depth`` terms, evaluated from the inside out, where
    e(2m) = m (b - m) x / ((a + 2m - 1)(a + 2m)) and e(2m+1) = -(a + m)(a + b + m) x / ((a + 2m)(a + 2m + 1))."""
    tail = np.ones_like(x)
    for j in range(depth, 0, -1):
        m = j // 2
        up = m * (b - m) if j % 2 == 0 else -(a + m) * (a + b + m)
        tail = 1.0 + up * x / ((a + j - 1) * (a + j)) / tail
    return 1.0 / tail


def _log_beta(a: float, b: float) -> float:
    """ln B(a, b); for a large argument from the asymptotic series of the gamma quotient, because the difference
    of two large log-gammas has no correct digits left."""
    large, small = max(a, b), min(a, b)
    if large < 1e5 or small > large / 1e3:
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    s = small
    return math.lgamma(s) - (s * math.log(large) + s * (s - 1) / (2 * large) - s * (s - 1) * (2 * s - 1) / (12 * large**2))


def _log(x, complement):
    return np.where(complement < 0.5, np.log1p(-complement), np.log(x))


def _lower_tail(a, b, x, y):
    """I_x(a, b) where x is below the mean (y = 1 - x): depth is doubled until the fraction no longer changes."""
    log_beta = np.vectorize(_log_beta, otypes=[float])(a, b)
    scale = np.exp(a * _log(x, y) + b * _log(y, x) - log_beta) / a
    depth, before, now = 64, None, _fraction(a, b, x, 32)
    while before is None or np.any(np.abs(now - before) > 1e-15 * np.abs(now)):
        if depth > 1 << 20:
            raise ArithmeticError("the continued fraction of the incomplete beta function does not settle")
        before, now, depth = now, _fraction(a, b, x, depth), depth * 2
    return scale * now


def reg_inc_beta(a, b, x, y=None):
    """I_x(a, b) for arrays (a, b > 0); x is cut to [0, 1], NaN arguments give NaN. ``y`` is 1 - x, for a caller
    who knows it more exactly than the subtraction gives it."""
    a, b, x, y = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float),
                                     1.0 - np.asarray(x, float) if y is None else np.asarray(y, float))
    out = np.where(np.isnan(a + b + x) | ~(a > 0) | ~(b > 0), np.nan, np.clip(x, 0.0, 1.0))
    inside = (x > 0) & (y > 0) & ~np.isnan(out)
    low = inside & (x <= (a + 1.0) / (a + b + 2.0))
    high = inside & ~low
    out[low] = _lower_tail(a[low], b[low], x[low], y[low])
    out[high] = 1.0 - _lower_tail(b[high], a[high], y[high], x[high])
    return out


@F.pandas_udf(T.DoubleType())
def p_from_r(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of Pearson r with n pairs (t distribution, n−2 df)."""
    r = r.astype(float).clip(-1 + 1e-15, 1 - 1e-15)
    df = (n.astype(float) - 2.0)
    t2 = r * r * df / (1.0 - r * r)
    p = reg_inc_beta(df / 2.0, 0.5, df / (df + t2), t2 / (df + t2))
    return pd.Series(np.where(df > 0, p, np.nan))


@F.pandas_udf(T.DoubleType())
def p_from_f(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper-tail p-value of an F statistic."""
    f, d1, d2 = f.astype(float), d1.astype(float), d2.astype(float)
    p = reg_inc_beta(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f))
    return pd.Series(p)


def stars(p: str = "p_value"):
    """Significance marker: *** <.001, ** <.01, * <.05, else ns."""
    c = F.col(p)
    return F.when(c < 0.001, "***").when(c < 0.01, "**").when(c < 0.05, "*").otherwise("ns")
