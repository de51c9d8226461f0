"""Time-blocked windows: point-in-time windows that never put one key's whole history in one task.

A plain ``Window.partitionBy(team)`` sends every row of a team to one task. With one team (or
pool, or pair) holding a third of all rows that task is the job. Here every key's history is cut
into date blocks ``_blk = floor(epoch_day / width)`` and windows are partitioned by
``(key…, _blk)``. Two small side tables restore exact answers across block edges:

* **halo** — for a bounded frame of depth ``n`` a block needs the last ``n`` rows before it.
  Each block's tail (``row_number() <= n``, planned as a partial WindowGroupLimit, so at most
  ``n`` rows per block leave the map side) is numbered per key; block ``b`` receives the tail
  rows numbered ``(before_b - n, before_b]`` by an equi-join on ``(key, ordinal)`` (the range is
  exploded to ``n`` ordinals, no range join). Halo rows are appended with ``_halo = <stream>``
  and dropped after the windows.
* **offsets** — unbounded running aggregates (season-to-date sums, streaks) are the in-block
  running value plus an exclusive prefix over earlier blocks, computed on the block table
  (one row per key and block).

The block width is sized from the data so the hottest key holds about ``target_rows`` rows per
block; when one block covers the whole span (small data) no halo or offset table is planned.
Blocks are whole days, so "same day" never crosses a block edge.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("match_date", "match_id")
BLOCK = "_blk"
HALO = "_halo"
DEFAULT_TARGET_ROWS = 100_000  # a task sorts and keeps its rows with all window columns, some 2.5 KB each
_EPOCH = "1970-01-01"


def block_width(df: DataFrame, keys, date_col: str = "match_date",
                target_rows: int | None = None) -> int:
    """Days per block so the largest key has about ``target_rows`` rows per block.

    One aggregate action returning a single row (map-side partial aggregation, no data to the
    driver). Returns a width covering the whole span when the data is small.
    """
    target_rows = target_rows or DEFAULT_TARGET_ROWS
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(date_col).alias("lo"),
                                    F.max(date_col).alias("hi"))
    row = per_key.agg(F.max("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    if row is None or row["n"] is None:
        return 1 << 20
    span = (row["hi"] - row["lo"]).days + 1
    if row["n"] <= target_rows:
        return 1 << 20  # one block: span is far below 2**20 days
    return max(1, math.floor(target_rows * span / row["n"]))


def dealt(df: DataFrame, keys: list[str], rows: int, target_rows: int | None = None) -> DataFrame:
    """``df`` of some ``rows`` rows dealt by ``keys`` (blocks), over more partitions than usual when those would hold several blocks each."""
    wanted = rows // (target_rows or DEFAULT_TARGET_ROWS)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(wanted, *keys) if wanted > usual else df.repartition(*keys)


def single_block(width: int) -> bool:
    return width >= (1 << 20)


def with_block(df: DataFrame, width: int, date_col: str = "match_date") -> DataFrame:
    if single_block(width):
        return df.withColumn(BLOCK, F.lit(0).cast("int"))
    return df.withColumn(BLOCK, F.floor(F.datediff(F.col(date_col), F.lit(_EPOCH).cast("date")) / width).cast("int"))


def with_halo(df: DataFrame, streams: dict, width: int, order=ORDER) -> DataFrame:
    """Append halo rows. ``streams`` maps a stream name to ``(keys, depth)``.

    Real rows get ``_halo = null``; halo rows carry their stream name and the block they are
    lent to. A window over stream ``s`` must partition by ``in_stream(s)`` as well, so it sees
    real rows plus its own halo only.
    """
    real = df.withColumn(HALO, F.lit(None).cast("string"))
    if single_block(width):
        return real
    parts = [real]
    for name, (keys, depth) in streams.items():
        keys = list(keys)
        desc = [F.col(c).desc() for c in order]
        tails = (df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, BLOCK).orderBy(*desc)))
                   .where(F.col("_r") <= depth).drop("_r"))
        tails = tails.withColumn("_ord", F.row_number().over(
            Window.partitionBy(*keys).orderBy(BLOCK, *order)))
        before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        need = (tails.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("_n"))
                .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
                .where(F.col("_before") > 0)
                .select(*keys, F.col(BLOCK).alias("_to"),
                        F.explode(F.sequence(F.greatest(F.col("_before") - depth + 1, F.lit(1)),
                                             F.col("_before"))).alias("_ord")))
        halo = (tails.join(need, [*keys, "_ord"])
                .withColumn(BLOCK, F.col("_to")).drop("_to", "_ord")
                .withColumn(HALO, F.lit(name)))
        parts.append(halo.select(*real.columns))
    return reduce(lambda a, b: a.unionByName(b), parts)


def in_stream(name: str) -> Column:
    """Membership flag of a windowed stream: real rows and that stream's halo rows."""
    return F.col(HALO).isNull() | (F.col(HALO) == F.lit(name))


def block_prefix(df: DataFrame, keys, sums: dict, width: int) -> DataFrame | None:
    """Exclusive prefix over earlier blocks of per-block sums.

    ``sums`` maps output name → column expression summed per block. Returns
    ``(keys…, _blk, name…)`` or ``None`` when there is one block (all prefixes are 0).
    """
    if single_block(width):
        return None
    keys = list(keys)
    agg = df.groupBy(*keys, BLOCK).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    w = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return agg.select(*keys, BLOCK, *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in sums])
