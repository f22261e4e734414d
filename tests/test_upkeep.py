"""Folding of closed days: rows kept, files counted, cut runs finished, later batches left alone."""

import pytest
from pyspark.sql import functions as F

from moodtide.schemas import SENTIMENT
from moodtide.sinks import tables, upkeep
from moodtide.sinks.tables import Store

DAY = "2024-01-01"
LABEL_OF = "element_at(array('positive', 'neutral', 'negative'), cast(id % 3 + 1 AS int))"


def stored(spark, tmp_path, batches=6, rows=400):
    store = Store(str(tmp_path / "store"), "w")
    for batch in range(batches):
        ids = spark.range(batch * rows, (batch + 1) * rows)
        made = ids.select(
            F.col("id").cast("string").alias("post_id"),
            F.element_at(F.array(F.lit("x"), F.lit("y")), (F.col("id") % 2 + 1).cast("int")).alias("platform"),
            F.lit("t").alias("text"),
            (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("id") * 37 % 1440).cast("int"))).alias("created_at"),
            F.from_json(F.to_json(F.struct(F.expr(LABEL_OF).alias("label"))), SENTIMENT).alias("sentiment"),
        )
        tables.insert_results(made, store, batch, f"{DAY} 23:59:00")
    return store


def ids(frame):
    return sorted(int(r.post_id) for r in frame.select("post_id").collect())


def folders(spark, store):
    return tables._folders(spark, f"{store.path('sentiment_results')}/day={DAY}/platform=*/writer=*/batch_id=*")


def test_a_folded_day_has_its_rows_in_few_files(spark, tmp_path):
    store = stored(spark, tmp_path)
    assert len(folders(spark, store)) == 12
    upkeep.fold_day(spark, store, "sentiment_results", DAY, rows_per_file=300)
    assert len(folders(spark, store)) == 2
    assert ids(store.read(spark, "sentiment_results")) == list(range(2400))
    before = folders(spark, store)
    upkeep.fold_day(spark, store, "sentiment_results", DAY)
    assert folders(spark, store) == before


def test_point_and_range_reads_open_few_files(spark, tmp_path):
    store = stored(spark, tmp_path)
    upkeep.fold_day(spark, store, "sentiment_results", DAY, rows_per_file=40)
    every = upkeep.files_for(spark, store, "sentiment_results", DAY)
    assert len(every) >= 40
    for asked, share in (({"key": "77"}, 0.65), ({"minutes": (0, 59)}, 0.65), ({"minutes": (600, 659), "label": "neutral"}, 0.45)):
        assert len(upkeep.files_for(spark, store, "sentiment_results", DAY, **asked)) <= share * len(every)
    assert ids(upkeep.read_folded(spark, store, "sentiment_results", DAY, key="77")) == [77]
    want = [i for i in range(2400) if 600 <= i * 37 % 1440 <= 659 and i % 3 == 1]
    assert ids(upkeep.read_folded(spark, store, "sentiment_results", DAY, minutes=(600, 659), label="neutral")) == want
    assert ids(upkeep.read_folded(spark, store, "sentiment_results", DAY, key="no such")) == []


@pytest.mark.parametrize("gone", [0, 5, 12])
def test_a_run_that_was_cut_short_is_finished(spark, tmp_path, gone):
    store = stored(spark, tmp_path)
    held, aside = folders(spark, store), f"{store.base}/_folding_sentiment_results/day={DAY}"
    upkeep._write_aside(spark, store, "sentiment_results", DAY, held, aside, 1000)
    for folder in held[:gone]:
        tables._remove(spark, folder)
    upkeep.fold_day(spark, store, "sentiment_results", DAY)
    assert ids(store.read(spark, "sentiment_results")) == list(range(2400)) and len(folders(spark, store)) == 2


def test_batches_that_come_later_are_read_and_folded_next_time(spark, tmp_path):
    store = stored(spark, tmp_path, batches=2)
    upkeep.fold_day(spark, store, "sentiment_results", DAY)
    more = store.read(spark, "sentiment_results").filter("post_id = '7'").withColumn("post_id", F.lit("9007")).drop("day", "writer", "batch_id")
    tables.insert_results(more, store, 9, f"{DAY} 23:59:30")
    assert ids(upkeep.read_folded(spark, store, "sentiment_results", DAY, key="9007")) == [9007]
    upkeep.fold_day(spark, store, "sentiment_results", DAY)
    assert ids(store.read(spark, "sentiment_results")) == [*range(800), 9007] and len(folders(spark, store)) <= 2
    assert ids(upkeep.read_folded(spark, store, "sentiment_results", DAY, key="9007")) == [9007]
