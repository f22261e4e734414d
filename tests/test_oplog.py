from datetime import datetime, timedelta

from pyspark.sql import functions as F

from moodtide.functions import timing
from moodtide.operators import oplog


def records(spark, count=230):
    start = datetime(2024, 1, 1)
    rows = [(i, "hot" if i % 3 else "rare", (i * 37 % 101) / 4, start + timedelta(seconds=23 * (i // 2))) for i in range(count)]
    rows.append((count, "hot", 1.5, None))
    return spark.createDataFrame(rows, "event_id int, operation string, duration double, timestamp timestamp"), rows


def ordered(rows, operation):
    own = [r for r in rows if r[1] == operation]
    return sorted(own, key=lambda r: (r[3] is not None, r[3] or datetime.min, r[0]))


def test_rolling_mean_over_small_blocks_is_the_plain_one(spark):
    df, rows = records(spark)
    got = {r.event_id: (r.position, r.rolling_avg) for r in oplog.rolling_avg_duration(df, 10, ["event_id"], block=12).collect()}
    assert len(got) == len(rows)
    for operation in ("hot", "rare"):
        own = ordered(rows, operation)
        for i, row in enumerate(own):
            frame = [r[2] for r in own[max(0, i - 9): i + 1]]
            assert got[row[0]][0] == i + 1 and abs(got[row[0]][1] - sum(frame) / len(frame)) < 1e-5


def test_running_index_keeps_null_keys_and_times(spark):
    df = records(spark)[0].withColumn("operation", F.when(F.col("operation") == "hot", F.col("operation")))
    numbered = oplog.running_index(df, ["operation"], ["timestamp", "event_id"], "n")
    assert numbered.count() == df.count()
    assert numbered.groupBy("operation").agg((F.max("n") == F.count("*")).alias("ok")).filter("ok").count() == 2


def test_last_n_is_over_all_operations(spark):
    df, rows = records(spark)
    got = oplog.op_avg_duration(df, 100, ["event_id"]).collect()
    assert sum(r.records for r in got) == 100


def test_retry_rules_in_order(spark):
    cases = [("Connection timeout", 5, True), ("Connection timeout", 6, False), ("429 too many requests", 4, True),
             ("Unauthorized", 1, False), ("network Forbidden", 1, True), ("weird", 3, True), ("weird", 4, False)]
    df = spark.createDataFrame(cases, "message string, n int, want boolean")
    assert df.filter(oplog.should_retry(F.col("message"), F.col("n")) != F.col("want")).count() == 0


def test_error_count_is_lifetime_but_window_is_on_the_last(spark):
    at = datetime(2024, 1, 1, 12)
    rows = [("a", "old", at - timedelta(hours=5)), ("a", "new", at - timedelta(minutes=5)), ("b", "m", at - timedelta(hours=1)), ("c", "m", None)]
    df = spark.createDataFrame(rows, "error_key string, message string, timestamp timestamp")
    got = oplog.error_summary(df, "2024-01-01 12:00:00").collect()
    assert [(r.error_key, r["count"], r.error_message) for r in got] == [("a", 2, "new")]
    assert oplog.error_summary(df, "2024-01-01 12:00:00", since="2024-01-01 10:00:00").first()["count"] == 1


def test_health_limits_are_strict(spark):
    samples = [(75.0, 1.0, 1.0, "healthy"), (75.1, 1.0, 1.0, "warning"), (90.0, 1.0, 1.0, "warning"), (90.1, 80.0, 1.0, "critical"),
               (1.0, 1.0, 85.0, "healthy"), (1.0, 1.0, 95.0, "warning"), (1.0, 1.0, 95.1, "critical"), (None, None, None, "error")]
    df = spark.createDataFrame(samples, "cpu_percent double, memory_percent double, disk_usage double, want string")
    checked = oplog.health_status(df)
    assert checked.filter(F.col("status") != F.col("want")).count() == 0
    both = checked.filter("cpu_percent = 90.1").first()
    assert both.issues == ["High CPU usage: 90.1%"] and both.warnings == ["Elevated memory usage: 80.0%"]


def test_clock_text(spark):
    df = spark.createDataFrame([(5.9,), (3661.0,), (90061.0,), (180000.0,)], "s double")
    got = [r[0] for r in df.select(timing.clock_text(F.col("s"))).collect()]
    assert got == ["0:00:05", "1:01:01", "1 day, 1:01:01", "2 days, 2:00:00"]
