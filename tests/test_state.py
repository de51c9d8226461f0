"""Streams with keyed state: restarts, late rows, idle keys."""

import datetime as dt

import pytest

from kickoff.streaming import run as SR
from kickoff.streaming import state as S

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def feed(spark, base, batches, **options):
    """One restart per batch from the same checkpoint; all rows so far."""
    with SR.state_store(spark):
        for rows in batches:
            spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{base}/in")
            stream = spark.readStream.schema(SCHEMA).parquet(f"{base}/in")
            SR._run(S.value_moves_state(stream, **options).writeStream.format("parquet").option("path", f"{base}/out")
                    .option("checkpointLocation", f"{base}/ckpt"))
    return sorted((r["event_id"], r["prev_value"], r["value"]) for r in spark.read.schema(S.OUT).parquet(f"{base}/out").collect())


def at(day, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)


def test_moves_go_on_after_a_restart_and_refuse_late_rows(spark, tmp_path):
    first = [(2, at(0, 2), 1, "a", 20.0), (1, at(0, 1), 1, "a", 10.0), (3, at(0), 2, "a", 5.0), (4, at(0), None, "a", 1.0)]
    second = [(5, at(1), 1, "a", 21.0), (6, at(1), 2, "a", 9.0), (7, at(1), 1, "b", 1.0), (8, at(1), None, "a", 2.0), (9, at(1, 1), 1, "a", None)]
    third = [(10, at(2), 1, "a", 50.0), (11, at(2), 2, "a", 0.0), (12, at(3), 2, "a", 7.0)]
    assert feed(spark, str(tmp_path), [first, second, third]) == [(2, 10.0, 20.0), (6, 5.0, 9.0), (8, 1.0, 2.0), (11, 9.0, 0.0)]
    with pytest.raises(Exception, match="arrived after a later one"):
        feed(spark, str(tmp_path), [[(13, at(1), 1, "a", 1.0)]])


def test_idle_keys_are_forgotten(spark, tmp_path):
    batches = [[(1, at(0), 1, "a", 10.0), (2, at(0), 2, "a", 10.0)], [(3, at(5), 2, "a", 20.0)], [(4, at(6), 2, "a", 20.0)], [(5, at(7), 1, "a", 99.0), (6, at(7), 2, "a", 40.0)]]
    got = feed(spark, str(tmp_path), batches, idle=dt.timedelta(days=30))
    assert (5, 10.0, 99.0) in got
    got = feed(spark, f"{tmp_path}/short", batches, idle=dt.timedelta(days=2))
    assert (6, 20.0, 40.0) in got and not [r for r in got if r[0] == 5]  # key 1 was idle for over two days


def test_rows_without_a_period_are_fed(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01"), (2, "2024-02"), (3, None), (4, "2024-01")], "id long, month string")
    seen = []
    SR._feed(spark, rows, "month", "id", str(tmp_path), "id long", lambda batch, epoch: seen.append(sorted(r["id"] for r in batch.collect())))
    assert seen == [[3], [1, 4], [2]]


def test_state_partitions_follow_cores_and_size():
    assert [SR.state_partitions(size, 12) for size in (0, 10 << 20, 100 << 20, 64 << 30)] == [4, 10, 24, 1024]
