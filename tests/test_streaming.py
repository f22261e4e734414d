import json

from pyspark.sql import functions as F

from moodtide import schemas
from moodtide.operators import scoring
from moodtide.sinks.tables import Store
from moodtide.sources import keywords as kw, landed
from moodtide.streaming import cycle, flows

POST = "id string, platform string, text string, collected_at timestamp, likes string"


def write(spark, folder, name, rows, schema=POST):
    frame = spark.createDataFrame([], schema) if not rows else spark.createDataFrame(
        rows, schema.replace("timestamp", "string")).withColumn("collected_at", F.col("collected_at").cast("timestamp"))
    frame.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def stream(spark, folder, schema=POST):
    layout = spark.createDataFrame([], schema).schema
    return flows.parquet_stream(spark, f"{folder}/*", layout)


def row(i, at, text="what a great useful day", likes="1", platform="x"):
    return (str(i), platform, text, at, likes)


def test_cycles_quarantine_store_score_and_can_be_resumed(spark, tmp_path):
    source, store = str(tmp_path / "in"), Store(str(tmp_path / "out"))
    one = cycle.Cycle(store, scoring.lexicon_scorer(scoring.starter_lexicon(spark), unique=True), "2024-01-31 00:00:00")
    write(spark, source, "a", [row(1, "2024-01-01 10:00:00"), row(1, "2024-01-01 10:05:00", "so bad and awful indeed"),
                               row(2, "2024-01-01 10:00:00", likes="many"), row(3, "2024-01-01 10:00:00", "short")])
    flows.run_once(stream(spark, source), one, str(tmp_path / "cp"))
    write(spark, source, "b", [row(4, "2024-01-01 11:00:00", likes=str(2**31))])
    flows.run_once(stream(spark, source), one, str(tmp_path / "cp"))
    results = {r.post_id: r for r in store.read(spark, "sentiment_results").collect()}
    assert set(results) == {"1", "4"}
    assert results["1"].sentiment.label == "negative" and results["4"].sentiment.label == "positive"
    assert results["4"].metadata.likes == 2**31 and str(results["4"].processed_at) == "2024-01-31 00:00:00"
    assert store.read(spark, "raw_posts").count() == 4
    assert spark.read.parquet(store.path("quarantine")).count() == 1
    assert spark.read.json(store.path("cycle_stats")).agg(F.sum("total")).first()[0] == 2


def test_a_cycle_with_only_bad_rows_goes_on(spark, tmp_path):
    source, store = str(tmp_path / "in"), Store(str(tmp_path / "out"))
    one = cycle.Cycle(store, scoring.lexicon_scorer(scoring.starter_lexicon(spark)))
    write(spark, source, "a", [row(2, "2024-01-01 10:00:00", likes="many")])
    flows.run_once(stream(spark, source), one, str(tmp_path / "cp"))
    assert store.read(spark, "sentiment_results").count() == 0
    assert spark.read.parquet(store.path("quarantine")).count() == 1


def test_replayed_batch_changes_nothing(spark, tmp_path):
    store = Store(str(tmp_path / "out"))
    one = cycle.Cycle(store, scoring.lexicon_scorer(scoring.starter_lexicon(spark)), "2024-01-31 00:00:00")
    write(spark, str(tmp_path / "in"), "a", [row(i, "2024-01-01 10:00:00") for i in range(5)])
    batch = spark.read.parquet(str(tmp_path / "in" / "a"))
    one(batch, 7)
    one(batch, 7)
    assert store.read(spark, "sentiment_results").count() == 5 and store.read(spark, "raw_posts").count() == 5


def test_dedup_holds_across_micro_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for name, rows in (("a", [row(1, "2024-01-01 10:00:00"), row(1, "2024-01-01 10:10:00")]), ("b", [row(1, "2024-01-01 10:20:00"), row(2, "2024-01-01 10:20:00")])):
        write(spark, source, name, rows)
        flows.run_once(flows.dedup_stream(stream(spark, source)), flows.append_batches(out), str(tmp_path / "cp"))
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["1", "2"]


def test_hourly_state_adds_up_and_late_rows_are_left_to_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrivals = [[row(1, "2024-01-01 10:10:00")], [row(2, "2024-01-01 10:50:00"), row(3, "2024-01-01 15:00:00")],
                [row(4, "2024-01-01 15:30:00")], [row(5, "2024-01-01 10:59:00")]]
    for i, rows in enumerate(arrivals):
        write(spark, source, f"f{i}", rows)
        counts = flows.hourly_counts(stream(spark, source), F.col("platform"), time="collected_at")
        flows.run_once(counts, flows.append_batches(out), str(tmp_path / "cp"), "update")
    got = {str(r.hour)[11:13]: r["count"] for r in flows.latest_changes(spark, out, ["hour", "label"], ["count"]).collect()}
    assert got == {"10": 2, "15": 2}


def test_sliding_summary_equals_a_sliding_window(spark):
    rows = spark.range(200).select(
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("id") * 37).cast("int"))).alias("at"),
        (F.col("id") % 3).cast("string").alias("label"),
    )
    hourly = rows.groupBy(F.date_trunc("hour", "at").alias("hour"), "label").count()
    ours = flows.sliding_summary(hourly)
    plain = rows.groupBy(F.window("at", "24 hours", "1 hour").alias("w"), "label").count().select("w.start", "label", "count")
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, plain.collect()))


def test_keywords_change_between_batches(spark, tmp_path):
    source, tracked, out = str(tmp_path / "in"), str(tmp_path / "kw"), str(tmp_path / "out")
    for name, keyword in (("a", "great"), ("b", "useful day")):
        kw.keyword_table(spark, [keyword]).write.mode("overwrite").parquet(tracked)
        write(spark, source, name, [row(name, "2024-01-01 10:00:00")])
        flows.run_once(stream(spark, source), cycle.keyword_writer(tracked, out), str(tmp_path / "cp"))
    assert sorted((r.id, r.keyword) for r in spark.read.parquet(out).collect()) == [("a", "great"), ("b", "useful day")]


def test_three_landed_sources_as_one_stream(spark, tmp_path):
    stamp = F.lit("2024-01-31")
    for name, record in (
        ("t", {"id": 1, "text": "AI", "created_at": "2024-01-01T00:00:00Z", "author_id": 1, "lang": "en"}),
        ("r", {"id": "p", "title": "AI", "selftext": "", "created_utc": 1.7e9, "subreddit": "python"}),
        ("y", {"items": [{"id": {"videoId": "v"}, "snippet": {"title": "AI", "publishedAt": "2024-01-01T00:00:00Z"}}]}),
    ):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.json").write_text(json.dumps(record))
    merged = flows.union_stream(
        landed.normalize_tweets(landed.stream_landed(spark, str(tmp_path / "t"), schemas.TWEET_JSON), stamp),
        landed.normalize_reddit_posts(landed.stream_landed(spark, str(tmp_path / "r"), schemas.SUBMISSION_JSON), stamp, ["python"]),
        landed.normalize_videos(landed.stream_landed(spark, str(tmp_path / "y"), schemas.VIDEO_SEARCH_JSON), stamp),
    )
    flows.run_once(merged, flows.append_batches(str(tmp_path / "out")), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.id, r.platform) for r in got.collect()) == [("1", "twitter"), ("p", "reddit"), ("v", "youtube")]


def test_a_running_query_can_be_stopped(spark, tmp_path):
    write(spark, str(tmp_path / "in"), "a", [row(1, "2024-01-01 10:00:00")])
    query = flows.start(stream(spark, str(tmp_path / "in")), flows.append_batches(str(tmp_path / "out")), str(tmp_path / "cp"), interval_seconds=1)
    query.processAllAvailable()
    query.stop()
    assert not query.isActive and spark.read.parquet(str(tmp_path / "out")).count() == 1
