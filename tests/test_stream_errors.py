"""The stream of retry decisions: order, restarts, late rows, expiry."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from moodtide.operators import oplog
from moodtide.streaming import errors as er, flows

SCHEMA = "event_id long, error_key string, message string, timestamp timestamp"
CLOCK = (-1, "clock", "tick", "2024-01-09 00:00:00")


def put(spark, folder, name, rows):
    frame = spark.createDataFrame(rows, SCHEMA.replace("timestamp timestamp", "timestamp string"))
    frame.withColumn("timestamp", F.col("timestamp").cast("timestamp")).coalesce(1).write.parquet(f"{folder}/{name}")
    return frame


def run(spark, tmp_path, batches, expiry=None):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    layout = spark.createDataFrame([], SCHEMA).schema
    for i, rows in enumerate(batches):
        put(spark, source, f"b{i}", rows)
        stream = er.retry_stream(flows.parquet_stream(spark, f"{source}/*", layout), expiry=expiry)
        flows.run_once(stream, flows.append_batches(out), str(tmp_path / "cp"))
    return spark.read.parquet(out).filter("error_key IS NULL OR error_key <> 'clock'")


def at(minute, key="k", message="weird", number=None):
    return (minute if number is None else number, key, message, f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00")


@pytest.mark.parametrize("restarts", [1, 2, 5])
def test_equals_the_batch_query_over_restarts(spark, tmp_path, restarts):
    rows = [at(m, f"k{m % 3}", ["weird", "Connection timeout", "Unauthorized"][m % 2]) for m in range(0, 300, 7)]
    rows += [at(60, "k0", "same minute", n) for n in (901, 900, 902)] + [at(5, None, "no key", 903)]
    size = -(-len(rows) // restarts)
    rows.sort(key=lambda r: r[3])
    batches = [list(reversed(rows[i : i + size])) for i in range(0, len(rows), size)]
    batches[-1].append(CLOCK)
    got = run(spark, tmp_path, batches).select("event_id", "error_key", "error_count", "should_retry")
    whole = spark.createDataFrame(rows, SCHEMA.replace("timestamp timestamp", "timestamp string"))
    whole = whole.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    want = oplog.retry_decision(whole, ["event_id"]).select("event_id", "error_key", "error_count", "should_retry")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rows_in_disorder_within_the_lateness_count_in_order(spark, tmp_path):
    got = run(spark, tmp_path, [[at(50)], [at(20)], [at(40), CLOCK]])
    assert {r.event_id: r.error_count for r in got.collect()} == {20: 1, 40: 2, 50: 3}


def test_too_late_rows_are_dropped_and_nothing_is_decided_early(spark, tmp_path):
    got = run(spark, tmp_path, [[at(10), at(200)], [at(190)], [at(15)], [at(250)]])
    assert {r.event_id: r.error_count for r in got.collect()} == {10: 1}


def test_a_quiet_key_is_forgotten(spark, tmp_path):
    quiet = timedelta(minutes=90)
    got = run(spark, tmp_path, [[at(0), at(60)], [at(300, "other")], [at(400), at(420), CLOCK]], quiet)
    assert {r.event_id: r.error_count for r in got.collect()} == {0: 1, 60: 2, 300: 1, 400: 1, 420: 2}
    last = {r.error_key: (r["count"], r.error_message) for r in er.last_errors(got).collect()}
    assert last == {"k": (2, "weird"), "other": (1, "weird")}


def test_an_expiry_within_one_batch_resets_too(spark, tmp_path):
    got = run(spark, tmp_path, [[at(0), at(200), at(210), CLOCK]], timedelta(minutes=90))
    assert {r.event_id: r.error_count for r in got.collect()} == {0: 1, 200: 1, 210: 2}


@pytest.mark.parametrize("store", ["HDFSBackedStateStoreProvider", None])
def test_runs_in_a_session_with_another_state_store(spark, tmp_path, store):
    before = spark.conf.get(flows.STATE_STORE)
    spark.conf.unset(flows.STATE_STORE)
    try:
        if store:
            spark.conf.set(flows.STATE_STORE, flows.KEYED_STORE.replace("RocksDBStateStoreProvider", store))
        found = spark.conf.get(flows.STATE_STORE)
        source, out = str(tmp_path / "in"), str(tmp_path / "out")
        put(spark, source, "b0", [at(0), at(20), at(30, "other"), CLOCK])
        stream = er.retry_stream(flows.parquet_stream(spark, f"{source}/*", spark.createDataFrame([], SCHEMA).schema))
        flows.run_once(stream, flows.append_batches(out), str(tmp_path / "cp"), keyed_state=True)
        assert spark.conf.get(flows.STATE_STORE) == found
    finally:
        spark.conf.set(flows.STATE_STORE, before)
    counts = spark.read.parquet(out).filter("error_key <> 'clock'").collect()
    assert {r.event_id: r.error_count for r in counts} == {0: 1, 20: 2, 30: 1}
