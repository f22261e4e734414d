"""Cycle counts from a stream's listener, and batches tried whole first."""

from pyspark.sql import functions as F

from moodtide.operators import scoring
from moodtide.streaming import flows, observed

SCHEMA = "id string, platform string, text string"


def test_counts_of_each_batch_come_from_the_listener(spark, tmp_path):
    listener = observed.CycleListener()
    spark.streams.addListener(listener)
    stages = [[("1", "x", "long enough"), ("2", "x", "no"), ("3", "y", "long enough")], [("4", None, "long enough"), ("5", "z", "no")], []]
    try:
        for n, rows in enumerate(stages):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
            posts = flows.parquet_stream(spark, str(tmp_path / "in/*"), spark.createDataFrame([], SCHEMA).schema)
            kept = F.length("text") > 5
            seen = observed.observed(posts, kept, kept & (F.col("platform") == "x"), ["x", "y"])
            flows.run_once(seen, flows.append_batches(str(tmp_path / "out")), str(tmp_path / "cp"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    got = listener.drain(spark)
    assert sorted(tuple(r)[1:] for r in got.collect()) == [(0, "x", 2, 1, 1), (0, "y", 1, 1, 0), (1, "other", 2, 1, 0)]
    assert got.select("run").distinct().count() == 1 and listener.drain(spark).count() == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_a_replayed_batch_counts_once():
    class Progress:
        id, batchId = "q", 3
        observedMetrics = {observed.OBSERVED: type("Row", (), {"asDict": lambda self: {"collected:x": 2, "kept:x": 1, "scored:x": 0}})()}

    class Event:
        progress = Progress

    listener = observed.CycleListener()
    listener.onQueryProgress(Event)
    listener.onQueryProgress(Event)
    assert list(listener._counts.values()) == [[("q", 3, "x", 2, 1, 0)]]


def test_rows_are_tried_one_by_one_only_where_a_batch_fails(spark):
    rows = spark.range(100).select("id", (F.col("id") % 10).cast("string").alias("text")).repartition(4, "id")

    def one(row):
        if row["id"] == 42:
            raise ValueError("no")
        return row["text"]

    def whole(batch):
        return [one(row) for row in batch]

    got = scoring.capture_errors(rows, one, "id", whole)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, scoring.capture_errors(rows, one, "id").collect()))
    assert [(r.id, r.error) for r in got.filter("NOT ok").collect()] == [(42, "ValueError: no")]
