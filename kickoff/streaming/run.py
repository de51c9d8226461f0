"""Drive the streaming jobs to completion (``availableNow``) over files Spark writes from the
driver's tables, and return the sink as a DataFrame. Checkpoints and sinks live under the
shared checkpoint folder."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.contests import contests
from ..sources.tables import read_table
from . import jobs as J
from . import state as S

CONTEST_STREAM_SCHEMA = ("div string, match_date date, match_id long, home_team string, away_team string, "
                         "fthg long, ftag long, ftr string")


def _dir(spark: SparkSession, kind: str) -> str:
    return scratch_path(spark, f"stream-{kind}-{uuid.uuid4().hex[:12]}")


def _run(query_builder) -> None:
    """Run to the end of the available input; ``availableNow`` stops by itself, an error is raised here."""
    query_builder.trigger(availableNow=True).start().awaitTermination()


def routed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2 end to end: stream the events table through the router, then count rows per type."""
    base = _dir(spark, "route")
    stream = J.read_events_stream(spark, sf_dir)
    _run(stream.writeStream.foreachBatch(J.route_by_type(f"{base}/out"))
         .option("checkpointLocation", f"{base}/ckpt"))
    out = spark.read.parquet(f"{base}/out")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


SHARDS = 256  # most files a period is written in
STATE_BYTES = 64 << 20  # input per partition of a state store
SMALL_STATE_BYTES = 1 << 20  # the same as long as there are cores left


def _feed(spark: SparkSession, rows: DataFrame, period: str, key: str, base: str, schema: str, write=None, query=None) -> None:
    """Feed ``rows`` period after period (a bounded calendar label, in date order) to a file stream: one micro-batch
    each, through ``write`` or the streaming ``query``. The source is scanned once, into a folder per period; a
    period is dealt over tasks by the row's ``key``. Rows without a period (a null time) are a period of their own, the first."""
    rows.repartition(period, F.pmod(F.xxhash64(key), F.lit(SHARDS))).write.partitionBy(period).parquet(f"{base}/periods")
    staged = spark.read.schema(f"{schema}, {period} string").parquet(f"{base}/periods")
    for label in [r[0] for r in staged.select(period).distinct().orderBy(period).collect()]:
        staged.where(F.col(period).eqNullSafe(label)).drop(period).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        _run((query(stream) if query else stream.writeStream.foreachBatch(write)).option("checkpointLocation", f"{base}/ckpt"))


def elo_stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4 end to end: contests streamed season by season through the incremental Elo, sunk to parquet, read back."""
    base = _dir(spark, "elo")
    c = contests(spark, sf_dir).select("div", "match_date", "match_id", "home_team", "away_team", "fthg", "ftag",
                                       "ftr", "season")
    _feed(spark, c, "season", "match_id", base, CONTEST_STREAM_SCHEMA, J.elo_batches(f"{base}/out"))
    return spark.read.schema(J.ELO_STREAM_OUT).parquet(f"{base}/out").where("match_id is not null").drop("epoch")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")


def sliding_averages_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 end to end: the windowed averages as a stream in complete mode; the last epoch is the answer (an epoch
    overwrites its own folder, so a replay changes nothing)."""
    base = _dir(spark, "sliding")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    _run(J.sliding_averages(J.read_events_stream(spark, sf_dir)).writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", f"{base}/ckpt"))
    out = spark.read.parquet(f"{base}/out")
    return out.where(F.col("epoch") == out.agg(F.max("epoch")).scalar()).drop("epoch")


def value_moves_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3 end to end as a stream, week by week."""
    base = _dir(spark, "moves")
    e = events(spark, sf_dir).select(*J.EVENT_COLS, F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week"))
    _feed(spark, e, "week", "event_id", base, J.MOVE_SCHEMA, J.move_batches(f"{base}/out"))
    return spark.read.schema(J.MOVE_OUT).parquet(f"{base}/out/moves").drop("epoch")


def state_partitions(size: int, cores: int) -> int:
    """Partitions of a state store for ``size`` bytes of input: keys are handled one by one in Python, so a small input of many keys is
    dealt over all cores as well; below ``SMALL_STATE_BYTES`` a partition is not worth its files."""
    return max(4, size // STATE_BYTES, min(2 * cores, size // SMALL_STATE_BYTES))


@contextmanager
def state_store(spark: SparkSession, rows: DataFrame | None = None):
    """The session with the state store that keyed state needs, and as many state partitions as the size of ``rows`` asks for (a
    checkpoint keeps its number); the former settings come back afterwards."""
    settings = {"spark.sql.streaming.stateStore.providerClass": S.STORE}
    if rows is not None:
        size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # optimizer's estimate
        settings["spark.sql.shuffle.partitions"] = str(state_partitions(size, spark.sparkContext.defaultParallelism))
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def value_moves_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3 end to end with keyed state in the state store, quarter by quarter; every period is a restart from the checkpoint."""
    base = _dir(spark, "moves-state")
    e = events(spark, sf_dir).select(*J.EVENT_COLS, F.date_format(F.date_trunc("quarter", "ts"), "yyyy-MM-dd").alias("quarter"))

    def query(stream: DataFrame):
        return S.value_moves_state(stream).writeStream.format("parquet").option("path", f"{base}/out").outputMode("append")

    with state_store(spark, e):
        _feed(spark, e, "quarter", "event_id", base, J.MOVE_SCHEMA, query=query)
    return spark.read.schema(S.OUT).parquet(f"{base}/out").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def elo_stateful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4 end to end with the ratings in the state store, season by season; every season is a restart from the checkpoint."""
    base = _dir(spark, "elo-state")
    c = contests(spark, sf_dir).select("div", "match_date", "match_id", "home_team", "away_team", "fthg", "ftag", "ftr", "season")

    def query(stream: DataFrame):
        return S.elo_state(stream).writeStream.format("parquet").option("path", f"{base}/out").outputMode("append")

    with state_store(spark, c):
        _feed(spark, c, "season", "match_id", base, CONTEST_STREAM_SCHEMA, query=query)
    return spark.read.schema(J.ELO_STREAM_OUT).parquet(f"{base}/out")
