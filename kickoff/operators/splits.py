"""Chronological splits, calibration carve-out and expanding time folds.

The reference splits by position in date order (``int(n * (1 - test_size))``). A global row
position is built without a single-partition window:

    repartitionByRange(date, id) → sortWithinPartitions(date, id)
    → monotonically_increasing_id = (partition << 33) + position-in-partition
    → per-partition counts (one row per partition) → exclusive prefix → index = offset + position

Only the per-partition count table (bounded by the number of partitions, a proven size bound)
is broadcast. The indexed table is checkpointed, because it is read more than once and the range
partitioner samples its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .order_stats import values_at

# Reference defaults.
TEST_SIZE = 0.2
CALIBRATION_FRACTION = 0.125
N_FOLDS = 5

_LOW33 = (1 << 33) - 1


def with_row_index(df: DataFrame, order=("match_date", "match_id"), partitions: int | None = None,
                   checkpoint: bool = True) -> DataFrame:
    """Add ``idx`` (0-based position in ``order``) to every row."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    tagged = ranged.withColumn("_mid", F.monotonically_increasing_id())
    tagged = (tagged.withColumn("_part", F.shiftright("_mid", 33))
                    .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit(_LOW33))))
    if checkpoint:
        tagged = materialize(tagged, "row-index")
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (tagged.join(F.broadcast(offsets), "_part")
            .withColumn("idx", F.col("_off") + F.col("_pos"))
            .drop("_mid", "_part", "_pos", "_off"))


def split_point(n: int, test_size: float = TEST_SIZE) -> int:
    return int(n * (1 - test_size))


def first_after(df: DataFrame, test_size: float = TEST_SIZE, date_col: str = "match_date", id_col: str = "match_id") -> dict | None:
    """Date and id of the first test row in (date, id) order, without numbering rows: one count per day, then the
    id at a rank of one day. None if no row is left to test. Ids are whole numbers."""
    days = sorted((r[date_col], r["count"]) for r in df.groupBy(date_col).count().collect())  # bounded by the calendar
    left = split_point(sum(n for _, n in days), test_size)
    for day, n in days:
        if left < n:
            ids = values_at(df.where(F.col(date_col) == F.lit(day)), [id_col], lambda _: [left])
            return {date_col: day, id_col: ids[id_col][0]}
        left -= n
    return None


def time_split(indexed: DataFrame, test_size: float = TEST_SIZE) -> DataFrame:
    """``split`` = train for the first ``int(n·(1−test_size))`` rows, else test."""
    n = indexed.count()
    cut = split_point(n, test_size)
    return indexed.withColumn("split", F.when(F.col("idx") < cut, "train").otherwise("test"))


def calibration_split(indexed: DataFrame, test_size: float = TEST_SIZE,
                      cal_fraction: float = CALIBRATION_FRACTION) -> DataFrame:
    """Train rows → ``fit`` (first ``int(n_train·(1−cal))``) and ``calibration``; rest ``test``."""
    n = indexed.count()
    cut = split_point(n, test_size)
    cal = int(cut * (1 - cal_fraction))
    return indexed.withColumn("split", F.when(F.col("idx") < cal, "fit")
                              .when(F.col("idx") < cut, "calibration").otherwise("test"))


def time_folds(indexed: DataFrame, n_splits: int = N_FOLDS, n: int | None = None) -> DataFrame:
    """Expanding-window folds (scikit-learn ``TimeSeriesSplit`` positions).

    ``fold`` = index of the fold whose test block holds the row, −1 for rows only ever trained on.
    Fold ``i`` trains on ``idx < first_test + i·size`` and tests on ``fold == i``.
    """
    if n is None:
        n = indexed.count()
    size = n // (n_splits + 1)
    first = n - n_splits * size
    return (indexed.withColumn("fold", F.when(F.col("idx") < first, F.lit(-1))
                               .otherwise(F.floor((F.col("idx") - first) / size)).cast("int"))
            .withColumn("fold_test_start", F.lit(first) + F.col("fold") * size))


def fold_bounds(n: int, n_splits: int = N_FOLDS) -> list[tuple[int, int, int]]:
    """(fold, train_end_exclusive, test_end_exclusive) for each fold."""
    size = n // (n_splits + 1)
    first = n - n_splits * size
    return [(i, first + i * size, first + (i + 1) * size) for i in range(n_splits)]


def split_profile(split_df: DataFrame, date_col: str = "match_date") -> DataFrame:
    """Row count and date range of each split."""
    return split_df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.min(date_col).alias("first_date"),
                                         F.max(date_col).alias("last_date"))
