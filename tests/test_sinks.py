import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from moodtide.session import shared_folder
from moodtide.sinks import tables as sinks


def posts(spark, rows):
    frame = spark.createDataFrame(rows, "id string, platform string, text string, collected_at string")
    return frame.withColumn("collected_at", F.col("collected_at").cast("timestamp"))


DAYS = [("1", "x", "t", "2024-01-01 10:00:00"), ("2", "x", "t", "2024-01-02 07:00:00"), ("3", "y", "t", "2024-01-02 09:00:00"),
        ("4", "x", "t", "2024-01-03 10:00:00")]


def ids(df):
    return sorted(r.id for r in df.collect())


def test_a_replayed_batch_replaces_itself_only(spark, tmp_path):
    store = sinks.Store(str(tmp_path))
    sinks.insert_raw_posts(posts(spark, DAYS[:2]), store, 0)
    sinks.insert_raw_posts(posts(spark, DAYS[2:]), store, 1)
    sinks.insert_raw_posts(posts(spark, DAYS[2:]), store, 1)
    assert ids(store.read(spark, "raw_posts")) == ["1", "2", "3", "4"]
    assert ids(store.read_batch(spark, "raw_posts", 1)) == ["3", "4"]
    assert store.read_batch(spark, "raw_posts", 9).count() == 0


def test_empty_insert_is_no_failure(spark, tmp_path):
    store = sinks.Store(str(tmp_path))
    sinks.insert_raw_posts(posts(spark, DAYS).limit(0), store, 0)
    assert store.read(spark, "raw_posts").count() == 0


def test_retention_drops_days_and_rewrites_only_the_edge(spark, tmp_path):
    store = sinks.Store(str(tmp_path))
    sinks.insert_raw_posts(posts(spark, DAYS), store, 0)
    for _ in range(2):
        sinks.enforce_retention(spark, store, "raw_posts", "2024-01-12 08:00:00", days=10)
    assert ids(store.read(spark, "raw_posts")) == ["3", "4"]
    assert not (tmp_path / "raw_posts" / "day=2024-01-01").exists()


def test_retention_cut_short_is_finished_by_the_next_run(spark, tmp_path, monkeypatch):
    store = sinks.Store(str(tmp_path))
    sinks.insert_raw_posts(posts(spark, DAYS), store, 0)
    real = sinks._remove

    def fail_after_removing_the_day(session, folder):
        real(session, folder)
        if folder.endswith("raw_posts/day=2024-01-02"):
            raise RuntimeError("lost")

    monkeypatch.setattr(sinks, "_remove", fail_after_removing_the_day)
    with pytest.raises(RuntimeError):
        sinks.enforce_retention(spark, store, "raw_posts", "2024-01-12 08:00:00", days=10)
    monkeypatch.setattr(sinks, "_remove", real)
    assert ids(store.read(spark, "raw_posts")) == ["4"]
    sinks.enforce_retention(spark, store, "raw_posts", "2024-01-12 08:00:00", days=10)
    assert ids(store.read(spark, "raw_posts")) == ["3", "4"]


def test_replay_under_another_stamp_leaves_no_copy(spark, tmp_path):
    store = sinks.Store(str(tmp_path))
    results = posts(spark, DAYS).withColumnRenamed("id", "post_id")
    sinks.insert_results(results, store, 3, "2024-01-31 23:59:59")
    sinks.insert_results(results, store, 3, "2024-02-01 00:00:01")
    stored = store.read(spark, "sentiment_results")
    assert stored.count() == 4 and {r.day for r in stored.select("day").collect()} == {"2024-02-01"}


def test_retention_counts_and_rows_without_time(spark):
    raw = posts(spark, [*DAYS, ("5", "x", "t", None)])
    results = raw.withColumnRenamed("collected_at", "processed_at")
    assert ids(sinks.retention_keep(raw, "collected_at", "2024-01-12 08:00:00", 10)) == ["3", "4", "5"]
    counts = sinks.retention_deleted_counts(raw, results, "2024-01-12 08:00:00", 10).collect()
    assert {r.table_name: r.deleted for r in counts} == {"raw_posts": 2, "sentiment_results": 2}


def test_partitions_prune_and_platform_is_pushed(spark, tmp_path):
    store = sinks.Store(str(tmp_path))
    sinks.insert_raw_posts(posts(spark, DAYS), store, 0)
    chosen = store.read(spark, "raw_posts").filter("platform = 'x' and day = '2024-01-02'")
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(platform" in plan and ids(chosen) == ["2"]


def test_envelope(spark):
    rows = spark.createDataFrame([("b", 2), ("a", 1)], "label string, count int")
    text = sinks.envelope(rows, "2024-01-31", with_count=True).first().json
    assert json.loads(text) == {"success": True, "data": [{"label": "a", "count": 1}, {"label": "b", "count": 2}],
                                "timestamp": "2024-01-31", "count": 2}
    assert json.loads(sinks.envelope(rows.limit(0), "t").first().json)["data"] == []


@pytest.mark.parametrize("kind", ["csv", "json", "parquet"])
def test_export_keeps_text_whole(spark, tmp_path, kind):
    rows = spark.createDataFrame([("a", 'say "hi", then\tgo'), ("b", "plain")], "id string, text string")
    path = str(tmp_path / kind)
    sinks.export_results(rows, path, kind)
    reader = spark.read.schema(rows.schema)
    back = reader.option("header", "true").option("escape", '"').csv(path) if kind == "csv" else reader.format(kind).load(path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


class Session:
    """Stands in for a session with other settings, which a running one cannot change."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = SimpleNamespace(master=master, applicationId=f"app-{master}")


def test_shared_folder_follows_the_session():
    assert shared_folder(Session("hdfs://x/y/", "yarn")) == "hdfs://x/y"
    local = shared_folder(Session(None, "local[2]"))
    assert local == shared_folder(Session(None, "local[2]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session(None, "yarn"))
