"""Structured Streaming jobs (R1–R5). Each transformation takes a DataFrame that may be static
or streaming, so the same code runs as a batch backfill and as a stream.

* R1 ``sliding_averages`` — 1-hour windows sliding every 10 minutes per event type, watermark
  1 hour (late rows beyond it are dropped by the stream; a batch run sees every row).
* R2 ``route_by_type`` — ``foreachBatch`` sink writing each micro-batch partitioned by type.
* R3 ``value_moves`` — relative change against the previous event of the same user and type,
  flagged above a threshold; previous rows come from a one-row halo per day block, so a hot
  user never lands whole in one task.
* R4 ``fold_elo`` — incremental Elo, one ordered fold per pool and micro-batch over sorted Arrow batches,
  with the ratings of the epoch before as its state; fed in date order it equals the batch fold.
* R5 ``rolling_48h`` — 48-hour rolling mean and volume per event type over epoch seconds,
  computed per 7-day block with the two preceding days appended as a halo.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.blocked import BLOCK, with_halo
from ..operators.elo import ELO_HOME_ADVANTAGE, ELO_INITIAL, apply_contests, with_stakes

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
WINDOW, SLIDE, WATERMARK = "1 hour", "10 minutes", "1 hour"
MOVE_THRESHOLD = 0.2
ROLL_SECONDS = 48 * 3600
ROLL_BLOCK_DAYS = 7


def read_events_stream(spark: SparkSession, folder: str, table: str = "events", files_per_trigger: int | None = None) -> DataFrame:
    """File stream over the event table of ``folder``. The pattern matches the table as one file and as a
    folder of part files (a stream source takes a folder or a pattern, not a plain file)."""
    r = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(f"{folder}/{table}*.parquet")


def sliding_averages(events: DataFrame) -> DataFrame:
    """R1. A watermark needs an instant, so the zone-less event time is read in the session's zone and the window
    bounds are given back without one."""
    w = F.window("at", WINDOW, SLIDE)
    return (events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", WATERMARK)
            .groupBy(w.alias("w"), "event_type")
            .agg(F.round(F.sum("value"), 9).alias("sum_value"), F.count("value").alias("n"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                    "event_type", "sum_value", "n", (F.col("sum_value") / F.col("n")).alias("avg_value")))


def route_by_type(out_dir: str):
    """R2: a ``foreachBatch`` function writing each micro-batch under ``epoch=…/event_type=…``; a replayed
    epoch overwrites its own folder, so rows arrive exactly once."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("event_type").parquet(f"{out_dir}/epoch={epoch_id}")
    return write


def value_moves(events: DataFrame, threshold: float = MOVE_THRESHOLD) -> DataFrame:
    """R3 (batch): events whose value moved more than ``threshold`` (relative) since the
    previous event of the same user and type."""
    keys = ["user_id", "event_type"]
    e = events.select("event_id", "ts", *keys, "value").withColumn(BLOCK, F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")))
    full = with_halo(e, {"prev": (keys, 1)}, width=0, order=("ts", "event_id"))
    w = Window.partitionBy(*keys, BLOCK).orderBy("ts", "event_id")
    prev = F.lag("value", 1).over(w)
    out = (full.withColumn("prev_value", prev).where(F.col("_halo").isNull())
           .withColumn("rel_change", F.when(F.col("prev_value") != 0,
                                            (F.col("value") - F.col("prev_value")) / F.abs(F.col("prev_value")))))
    return (out.where(F.abs(F.col("rel_change")) > threshold)
            .select("event_id", "ts", *keys, "prev_value", "value", F.round("rel_change", 9).alias("rel_change")))


MOVE_OUT = "event_id long, ts timestamp_ntz, user_id long, event_type string, prev_value double, value double, rel_change double"
MOVE_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
EVENT_COLS = ["event_id", "ts", "user_id", "event_type", "value"]


def last_events(events: DataFrame) -> DataFrame:
    """The latest event of every (user, type): the state of R3 as a stream (partial aggregation, no key is gathered)."""
    last = F.max_by(F.struct("event_id", "ts", "value"), F.struct("ts", "event_id")).alias("e")
    return events.groupBy("user_id", "event_type").agg(last).select("e.event_id", "e.ts", "user_id", "event_type", "e.value")


def move_batches(out_dir: str, threshold: float = MOVE_THRESHOLD):
    """R3 as a stream: a ``foreachBatch`` function. A micro-batch, preceded by the latest event of every key so far
    (the state, one row a key, kept by epoch), goes through ``value_moves``, whose blocks split a hot key. A replayed
    epoch reads the state of the one before and overwrites its own folders. An event older than what was applied has no
    defined predecessor any more and raises."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        events, keys = batch.select(*EVENT_COLS), ["user_id", "event_type"]
        if epoch_id:
            held = spark.read.parquet(f"{out_dir}/state/epoch={epoch_id - 1}")
            first = events.groupBy(*keys).agg(F.min(F.struct("ts", "event_id")).alias("first"))
            late = first.join(held, keys).where(F.col("first") < F.struct("ts", "event_id")).select(*keys, "first.ts").first()
            if late:
                raise ValueError(f"an event of ({late[0]}, {late[1]}) arrived after a later one was applied: {late[2]}")
            events = held.unionByName(events)
        value_moves(events, threshold).write.mode("overwrite").parquet(f"{out_dir}/moves/epoch={epoch_id}")
        last_events(events).write.mode("overwrite").parquet(f"{out_dir}/state/epoch={epoch_id}")
    return write


def rolling_48h(events: DataFrame) -> DataFrame:
    """Mean value and count over the 48 hours up to and including each event, per type.

    Rows are first reduced to one per type and second (partial aggregation), so a hot type costs at most
    86,400 rows a day. The sliding sum is a difference of running sums within a block of days: the running
    sum now minus the running sum as of 48 hours and a second ago, both exact decimals; the halo lends every
    block the seconds of the 48 hours before it.
    """
    sec = F.unix_seconds(F.col("ts").cast("timestamp"))  # session time zone is UTC
    base = events.select("event_id", "ts", "event_type", "value", sec.alias("sec"))
    seconds = base.groupBy("event_type", "sec").agg(F.sum(F.col("value").cast("decimal(30,12)")).alias("v"),
                                                   F.count("value").alias("c"))
    width = ROLL_BLOCK_DAYS * 86400
    block = F.floor(F.col("sec") / width).cast("long")
    own = seconds.withColumn(BLOCK, block).withColumn("_h", F.lit(False))
    halo = (own.where(F.col("sec") >= (F.col(BLOCK) + 1) * width - ROLL_SECONDS)
            .withColumn(BLOCK, F.col(BLOCK) + 1).withColumn("_h", F.lit(True)))
    w = Window.partitionBy("event_type", BLOCK).orderBy("sec")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # as of the second before the window: the last running sum at or before sec - 48 h - 1 s
    marks = own.unionByName(halo).withColumns({
        "rv": F.coalesce(F.sum("v").over(run), F.lit(0)), "rc": F.sum("c").over(run)})
    ask = marks.where(~F.col("_h")).select("event_type", BLOCK, F.col("sec").alias("at"),
                                           (F.col("sec") - ROLL_SECONDS - 1).alias("sec"), F.lit(None).cast(
        marks.schema["rv"].dataType).alias("pv"), F.lit(None).cast("long").alias("pc"), F.lit(1).alias("k"))
    known = marks.select("event_type", BLOCK, F.lit(None).cast("long").alias("at"), "sec", F.col("rv").alias("pv"),
                         F.col("rc").alias("pc"), F.lit(0).alias("k"))
    back = Window.partitionBy("event_type", BLOCK).orderBy("sec", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = (known.unionByName(ask).withColumns({"pv": F.last("pv", ignorenulls=True).over(back),
                                                 "pc": F.last("pc", ignorenulls=True).over(back)})
              .where("k = 1").select("event_type", F.col("at").alias("sec"), "pv", "pc"))
    sums = marks.where(~F.col("_h")).join(before, ["event_type", "sec"]).select(
        "event_type", "sec", F.round((F.col("rv") - F.coalesce("pv", F.lit(0))).cast("double"), 9).alias("s"),
        (F.col("rc") - F.coalesce("pc", F.lit(0))).alias("n_48h"))
    return (base.join(sums, ["event_type", "sec"])
            .withColumn("sum_48h", F.when(F.col("n_48h") > 0, F.col("s")))
            .select("event_id", "ts", "event_type", "sum_48h", "n_48h", (F.col("sum_48h") / F.col("n_48h")).alias("avg_48h")))


# ------------------------------------------------------------------ R4 incremental Elo
ELO_STREAM_OUT = ("match_id long, div string, home_elo double, away_elo double, "
                  "home_elo_post double, away_elo_post double")
ELO_COLS = [c.split()[0] for c in ELO_STREAM_OUT.split(", ")]


class _Held:
    """The state of one pool: a JSON text of its ratings (bounded by its teams) and its last date."""

    def __init__(self, text: str | None = None) -> None:
        self.exists, self.get = text is not None, (text,)

    def update(self, value: tuple) -> None:
        self.exists, self.get = True, value


def _elo_update(home_advantage: float = ELO_HOME_ADVANTAGE, initial: float = ELO_INITIAL):
    edge, start = float(home_advantage), float(initial)

    def fn(key, pdfs, state):
        """Fold the frames of a pool, in (date, id) order, one at a time; the state is {team: rating} and the last date."""
        held = json.loads(state.get[0]) if state.exists else {"ratings": {}, "last": ""}
        ratings, last = {(key[0], team): r for team, r in held["ratings"].items()}, held["last"]
        for pdf in pdfs:
            if not len(pdf):
                continue
            if str(pdf["match_date"].iloc[0]) < last:
                raise ValueError(f"contests of pool {key[0]} arrived out of date order: {pdf['match_date'].iloc[0]} after {last}")
            out = apply_contests(pdf, ratings, edge, start)
            last = str(pdf["match_date"].iloc[-1])
            yield out[ELO_COLS]
        state.update((json.dumps({"ratings": {team: r for (_, team), r in ratings.items()}, "last": last}),))
    return fn


def fold_elo(contests: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """The contests of a micro-batch applied in (date, id) order by the kernel of the batch fold, starting from ``held``
    (div, state). Spark sorts (and spills); the fold sees one Arrow batch at a time. Rows with a null ``match_id`` are the
    pools' states after it. Contests older than what was applied raise instead of giving wrong ratings."""
    cols = ["div", "match_date", "match_id", "home_team", "away_team", "score", "stake"]
    rows = with_stakes(contests).select(*cols, F.lit(None).cast("string").alias("state"))
    if held is not None:  # a null date sorts first: a pool's state precedes its contests
        rows = rows.unionByName(held.select("div", "state"), allowMissingColumns=True)
    step = _elo_update()

    def fold(frames):
        states: dict = {}
        for pdf in frames:
            for div, part in pdf.groupby("div", sort=False):
                own = states.setdefault(div, _Held())
                known = part["state"].notna()
                for text in part.loc[known, "state"]:
                    own.update((text,))
                yield from (out.assign(state=None) for out in step((div,), iter([part[~known]]), own))
        yield pd.DataFrame([(None, div, None, None, None, None, own.get[0]) for div, own in states.items()],
                           columns=[*ELO_COLS, "state"]).astype({"match_id": "Int64"})

    ordered = rows.repartition("div").sortWithinPartitions("div", F.col("match_date").asc_nulls_first(), "match_id")
    return ordered.mapInPandas(fold, ELO_STREAM_OUT + ", state string")


def elo_batches(out_dir: str):
    """R4 as a stream: a ``foreachBatch`` function; ratings and states are written by epoch, a replayed epoch starts
    from the states of the one before and overwrites its own folder."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        held = None
        if epoch_id:
            held = (batch.sparkSession.read.parquet(f"{out_dir}/epoch={epoch_id - 1}")
                    .where("match_id is null").select("div", "state"))
        fold_elo(batch, held).write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch_id}")
    return write
