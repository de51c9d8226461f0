"""A4: exact (interpolated) medians of many columns without gathering a column in one place.

``percentile``/``median`` keep every distinct value of a column in one aggregation buffer, and a wide aggregation of 59 sketches
and their counts is too large for generated code. The two middle values of all columns come from ``order_stats``
(a few scans with histograms of bounded size); the caller should materialise an expensive plan first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .order_stats import values_at


def exact_medians(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """Median of every column (nulls and NaN skipped, the mean of the two middle values), None without values."""
    middle = values_at(df, cols, lambda n: sorted({(n - 1) // 2, n // 2}) if n else [])
    # same interpolation as Spark/DuckDB percentile
    return {c: float(v[0] + (v[-1] - v[0]) * 0.5) if v else None for c, v in middle.items()}
