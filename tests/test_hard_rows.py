"""Rows that the derived tables do not hold: null ids and batches, ties, edited posts, long ids, two writers."""

import pandas as pd
from pyspark.sql import functions as F

from moodtide.operators import cleaning, enrich, evaluation, features, oplog, scoring, trends
from moodtide.operators.sizing import salted_lookup
from moodtide.sinks import tables as sinks
from moodtide.streaming import flows

LONG = 1890123456789012345


def posts(spark, rows):
    frame = spark.createDataFrame(rows, "id string, platform string, text string, likes long, collected_at string")
    return frame.withColumn("collected_at", F.col("collected_at").cast("timestamp"))


def test_two_writers_may_share_a_batch_number(spark, tmp_path):
    one, two = sinks.Store(str(tmp_path), "one"), sinks.Store(str(tmp_path), "two")
    for store, ids in ((one, "ab"), (two, "cd"), (one, "ab")):
        rows = posts(spark, [(i, "x", "t", 1, "2024-01-01 10:00:00") for i in ids])
        sinks.insert_raw_posts(rows, store, 0)
    assert sorted(r.id for r in one.read(spark, "raw_posts").collect()) == ["a", "b", "c", "d"]
    assert sorted(r.id for r in two.read_batch(spark, "raw_posts", 0).collect()) == ["c", "d"]


def test_a_reset_checkpoint_is_another_writer(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = posts(spark, [("1", "x", "t", 1, "2024-01-01 10:00:00")])
    rows.write.parquet(source)
    for name in ("first", "second"):
        stream = flows.parquet_stream(spark, source, rows.schema)
        flows.run_once(stream, flows.append_batches(out), str(tmp_path / name))
    found = spark.read.parquet(out)
    assert found.count() == 2 and found.select("writer").distinct().count() == 2


def test_rows_without_id_are_told_apart_by_content_in_streams_as_in_tables(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = posts(spark, [(None, "x", t, 1, "2024-01-01 10:00:00") for t in ("a", "b", "b", "c")])
    rows.coalesce(1).write.parquet(source)
    stream = flows.dedup_stream(flows.parquet_stream(spark, source, rows.schema))
    flows.run_once(stream, flows.append_batches(out), str(tmp_path / "check"))
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    assert sorted(r.text for r in cleaning.dedup_posts(rows).collect()) == ["a", "b", "c"]


def test_equal_times_and_texts_have_one_survivor_in_any_order(spark):
    rows = [("1", "x", "t", likes, "2024-01-01 10:00:00") for likes in range(9)]
    first, second = (cleaning.dedup_posts(posts(spark, r).coalesce(1)).first().likes for r in (rows, rows[::-1]))
    assert first == second


def test_rows_without_a_batch_are_padded_too(spark):
    rows = spark.createDataFrame([(1, [1, 2]), (1, [3]), (None, [4]), (None, [5, 6, 7])], "batch long, input_ids array<int>")
    got = sorted((r.batch or 0, r.input_ids) for r in features.pad_sequences(rows, batch=["batch"]).collect())
    assert got == [(0, [4, 0, 0]), (0, [5, 6, 7]), (1, [1, 2]), (1, [3, 0])]


def test_an_edited_post_is_scored_by_its_own_text(spark, monkeypatch):
    rows = posts(spark, [("1", "x", "good", 1, "2024-01-01 10:00:00"), ("1", "x", "bad bad bad", 1, "2024-01-02 10:00:00"), ("2", "x", None, 1, "2024-01-02 10:00:00")])
    lexicon = scoring.starter_lexicon(spark)
    want = {"good": 0.65, "bad bad bad": -0.65, None: 0.0}
    for small in (True, False):
        monkeypatch.setattr(scoring, "is_small", lambda _, small=small: small)
        got = {r.text: r.sentiment.polarity for r in scoring.lexicon_sentiment(rows, lexicon).collect()}
        assert got == want


def test_rows_without_id_or_platform_are_scored_alike_whatever_the_lexicon_holds(spark, monkeypatch):
    rows = posts(spark, [(None, "x", "good day", 1, "2024-01-01 10:00:00"), ("1", None, "bad day", 1, "2024-01-01 10:00:00"),
                         (None, None, "not good", 1, "2024-01-01 10:00:00"), (None, None, "not good", 1, "2024-01-01 10:00:00")])
    lexicon = scoring.starter_lexicon(spark)
    for small in (True, False):
        for unique in (True, False):
            monkeypatch.setattr(scoring, "is_small", lambda _, small=small: small)
            got = scoring.lexicon_sentiment(rows, lexicon, negators=scoring.NEGATORS, unique=unique)
            assert sorted((r.text, r.sentiment.polarity) for r in got.collect()) == [("bad day", -0.65), ("good day", 0.65), ("not good", -0.325), ("not good", -0.325)]
            assert got.columns == [*rows.columns, "sentiment"]


def test_entries_that_a_lexicon_repeats_and_batches_without_words(spark):
    lexicon = spark.createDataFrame([("good", 50, 10), ("good", 70, None), (None, 9, 9)], "token string, polarity_points int, subjectivity_points int")
    rows = posts(spark, [("1", "x", "good good", 1, "2024-01-01 10:00:00"), ("2", "x", "", 1, "2024-01-01 10:00:00"), ("3", "x", None, 1, "2024-01-01 10:00:00")])
    got = {r.id: (r.sentiment.polarity, r.sentiment.label) for r in scoring.lexicon_sentiment(rows, lexicon).collect()}
    assert got == {"1": (0.6, "positive"), "2": (0.0, "neutral"), "3": (0.0, "neutral")}
    assert scoring.lexicon_sentiment(rows.limit(0), lexicon).count() == 0


def test_zscore_looks_back_over_hours_and_needs_a_deviation(spark):
    shares = [0, 1, 0, 1, 0, 1, 0, 4]  # negatives of four rows in each hour
    rows = [("x", f"2024-01-01 {h:02d}:{m:02d}:00", "negative" if m < n else "positive") for h, n in enumerate(shares) for m in range(4)]
    rows += [("flat", f"2024-01-01 {h:02d}:00:00", "negative" if h == 9 else "positive") for h in range(10)]
    frame = spark.createDataFrame(rows, "platform string, processed_at string, label string")
    results = frame.select("platform", F.col("processed_at").cast("timestamp").alias("processed_at"), F.struct("label").alias("sentiment"))
    got = trends.sentiment_zscore_alerts(results).collect()
    mean, deviation = 75 / 7, (sum((s * 25 - 75 / 7) ** 2 for s in shares[:7]) / 6) ** 0.5
    assert [(r.platform, r.hour.hour, r.hours, r.zscore) for r in got] == [("x", 7, 7, round((100 - mean) / deviation, 6))]


def test_drift_needs_a_lasting_fall(spark):
    def days(accuracies):
        return spark.createDataFrame([(f"2024-01-{d:02d}", 1, 1 if k < a else 0) for d, a in enumerate(accuracies, 1) for k in range(10)], "at string, y int, yhat int")

    one_bad = evaluation.accuracy_drift(days([9, 6, 9, 9]), "at").orderBy("day").collect()
    assert [r.drift for r in one_bad] == [False] * 4 and [r.shortfall for r in one_bad] == [0.0, 0.18, 0.06, 0.0]
    lasting = evaluation.accuracy_drift(days([9, 7, 6, 7, 9]), "at").orderBy("day").collect()
    assert [r.drift for r in lasting] == [False, False, True, True, False]
    assert evaluation.accuracy_drift(days([]), "at").count() == 0


def test_the_scorer_moves_no_text(spark):
    rows = posts(spark, [("1", "x", "good", 1, "2024-01-01 10:00:00")]).withColumn("created_at", F.col("collected_at"))
    plan = scoring.score_posts(rows, scoring.lexicon_scorer(scoring.starter_lexicon(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_long_integers_and_nulls_pass_python_unchanged(spark):
    rows = spark.createDataFrame([("a", LONG, "t"), ("b", None, "u")], "id string, author long, text string")
    scored = scoring.callable_scorer(lambda s: pd.DataFrame({"label": ["neutral"] * len(s), "confidence": 0.5}), ["id", "author"])(rows)
    assert {r.author for r in scored.collect()} == {LONG, None}
    caught = scoring.capture_errors(rows, lambda row: repr(row["author"]), "author").collect()
    assert {(r.author, r.payload) for r in caught} == {(LONG, str(LONG)), (None, "None")}
    mapped = scoring.map_batches(rows, lambda df: df[["id", "author"]], "id string, author long")
    assert {(r.id, r.author) for r in mapped.collect()} == {("a", LONG), ("b", None)}


def test_alerts_do_not_reach_over_gaps(spark):
    rows = [("x", f"2024-01-0{d} 10:{m:02d}:00", label) for d, label in ((1, "negative"), (5, "positive")) for m in range(4)]
    rows += [("x", f"2024-01-05 11:{m:02d}:00", "negative") for m in range(4)]
    frame = spark.createDataFrame(rows, "platform string, processed_at string, label string")
    results = frame.select("platform", F.col("processed_at").cast("timestamp").alias("processed_at"), F.struct("label").alias("sentiment"))
    got = trends.sentiment_alerts(results).collect()
    assert [(r.hour.day, r.hour.hour, r.change) for r in got] == [(5, 11, 100.0)]


def test_the_newest_counters_of_a_video_and_null_keys(spark):
    videos = spark.createDataFrame([("v",), ("w",), (None,)], "id string")
    stats = spark.createDataFrame([("v", 10, 1, 1), ("v", 20, 2, 2)], "video_id string, views long, likes long, comments long")
    got = {r.id: r.views for r in enrich.video_engagement(videos, stats).collect()}
    assert got == {"v": 20, "w": 0, None: 0}
    assert salted_lookup(videos, videos.filter("id = 'v'"), ["id"], "left_anti").count() == 2


def test_an_envelope_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(sinks, "ENVELOPE_ROWS", 3)
    assert sinks.envelope(spark.range(3), "t").count() == 1
    try:
        sinks.envelope(spark.range(4), "t").collect()
    except Exception as problem:
        assert "more than 3 rows" in str(problem)
    else:
        raise AssertionError("no bound")


def test_a_full_status_report(spark):
    metrics = spark.createDataFrame([("2024-01-01 10:00:00", 95.0, 80.0, 10.0)], "timestamp string, cpu_percent double, memory_percent double, disk_usage double")
    timings = spark.createDataFrame([("a", 1.0, "2024-01-01"), ("a", 2.0, "2024-01-01")], "operation string, duration double, timestamp string")
    errors = spark.createDataFrame([], "api string, error_type string, error string, traceback string, timestamp timestamp, error_key string, message string")
    got = {(r.section, r.name): r.value for r in oplog.status_report(metrics.withColumn("timestamp", F.col("timestamp").cast("timestamp")), timings.withColumn("timestamp", F.col("timestamp").cast("timestamp")), errors, "2024-01-01 11:00:00").collect()}
    assert got["health", "status"] == "critical" and got["health", "issues"].startswith("High CPU") and got["health", "warnings"].startswith("Elevated memory")
    assert got["timing", "a"] == "1.500" and got["timing", "total"] == "2"


def test_only_rare_words_travel_to_a_large_lexicon(spark, monkeypatch):
    """The sums by frequency are those of sent entries, and a word that is said often costs no row of its own."""
    texts = [f"good bad not good day day rare{chr(97 + i)} odd{chr(97 + i)} " + "good night " * i for i in range(20)] + [None, "", "day"]
    rows = posts(spark, [(str(i), "x", text, 1, "2024-01-01 10:00:00") for i, text in enumerate(texts)])
    entries = [("good", 65, 60), ("good", 5, None), ("bad", -65, None), ("night", None, 5), (None, 9, 9)]
    entries += [(f"rare{chr(97 + i)}", i, 1) for i in range(20)]
    lexicon = spark.createDataFrame(entries, "token string, polarity_points int, subjectivity_points int")
    tails, sums, spread = [], {}, scoring.spread
    monkeypatch.setattr(scoring, "SENT_WORDS", 5)
    monkeypatch.setattr(scoring.settings, "HOT_KEY_ROWS", 1)
    monkeypatch.setattr(scoring, "spread", lambda keys, parts: tails.append(keys) or spread(keys, parts))
    for small in (True, False):
        monkeypatch.setattr(scoring, "is_small", lambda _, small=small: small)
        got = scoring.lexicon_polarity(rows, lexicon, ["id"], scoring.NEGATORS)
        sums[small] = sorted(map(tuple, got.collect()))
    assert sums[True] == sums[False] and len(sums[True]) == 20
    assert tails == [["id"]]
    sent = sorted(row.token for row in scoring._frequent_words(rows).collect())
    assert sent == ["bad", "day", "good", "night", "not"]
