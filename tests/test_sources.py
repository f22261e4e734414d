import json

from pyspark.sql import functions as F

from moodtide import schemas
from moodtide.functions.hashing import in_test_split
from moodtide.operators import cleaning
from moodtide.sources import conform as cf, landed
from moodtide.sources.labelled import load_labelled, rename_labels



def stamp():
    return F.lit("2024-01-31 00:00:00")


def landed_file(tmp_path, name, records):
    folder = tmp_path / name
    folder.mkdir()
    lines = [r if isinstance(r, str) else json.dumps(r) for r in records]
    (folder / "part.json").write_text("\n".join(lines))
    return str(folder)


def tweet(i, text, lang="en", **metrics):
    return {"id": i, "text": text, "created_at": f"2024-01-01T00:00:0{i}Z", "author_id": 7, "lang": lang, "public_metrics": metrics}


def test_tweets_from_files_with_a_broken_line(spark, tmp_path):
    records = [tweet(1, "python here", like_count=2**31, retweet_count=1), tweet(2, "python ici", "fr"), tweet(3, "nothing"),
               tweet(4, "AI soon"), "{broken"]
    raw = landed.read_landed(spark, landed_file(tmp_path, "tweets", records), schemas.TWEET_JSON)
    good, bad = cf.split_quarantine(raw, F.col("_corrupt_record").isNotNull())
    assert (good.count(), bad.count()) == (4, 1)
    got = {r.id: r for r in landed.normalize_tweets(good, stamp()).collect()}
    assert set(got) == {"1", "4"}
    assert (got["1"].likes, got["4"].likes) == (2**31, 0) and got["1"].keywords == ["python", "AI", "machine learning"]


def test_the_cap_comes_before_the_language_test(spark, tmp_path):
    records = [tweet(1, "AI one"), tweet(2, "AI two"), tweet(3, "AI trois", "fr")]
    raw = landed.read_landed(spark, landed_file(tmp_path, "tweets", records), schemas.TWEET_JSON)
    assert [r.id for r in landed.normalize_tweets(raw, stamp(), max_results=2).collect()] == ["2"]


def test_reddit_posts_once_per_keyword_with_shared_cap(spark, tmp_path):
    base = {"ups": 1, "downs": 0, "score": 1, "num_comments": 0, "author": None}
    records = [{"id": f"p{i}", "title": "AI", "selftext": "python", "created_utc": 1704067200.0 + i, "subreddit": s, **base}
               for i, s in enumerate(["python", "python", "python", "other"])]
    raw = landed.read_landed(spark, landed_file(tmp_path, "reddit", records), schemas.SUBMISSION_JSON)
    got = landed.normalize_reddit_posts(raw, stamp(), ["python"], ["python", "AI"], limit=4).collect()
    assert sorted((r.id, r.matched_keyword) for r in got) == [("p1", "AI"), ("p1", "python"), ("p2", "AI"), ("p2", "python")]
    assert {r.author for r in got} == {"[deleted]"}


def test_video_without_text_survives_by_fallback(spark, tmp_path):
    item = {"id": {"videoId": "v1"}, "snippet": {"title": "", "description": "all about python", "channelTitle": "c",
                                               "publishedAt": "2024-01-01T10:00:00Z"}}
    raw = landed.read_landed(spark, landed_file(tmp_path, "videos", [{"items": [item, item]}]), schemas.VIDEO_SEARCH_JSON)
    videos = cf.union_sources(landed.normalize_videos(raw, stamp()))
    assert videos.columns == schemas.POST.names and videos.count() == 2
    assert landed.normalize_videos(raw, stamp(), limit=1).count() == 1
    row = cleaning.text_fallback(videos).first()
    assert row.text == "all about python" and str(row.created_at) == "2024-01-01 10:00:00"
    assert cleaning.clean_posts(cleaning.text_fallback(videos)).count() == 2


def test_missing_or_unreadable_counters_are_zero(spark, tmp_path):
    records = [{"video_id": "a", "viewCount": "12"}, {"video_id": "b", "viewCount": "x", "likeCount": "3"}]
    raw = landed.read_landed(spark, landed_file(tmp_path, "stats", records), schemas.VIDEO_STATS_JSON)
    assert sorted(map(tuple, landed.video_stats(raw).collect())) == [("a", 12, 0, 0), ("b", 0, 3, 0)]


def test_conform_drops_fills_and_never_fails(spark):
    rows = spark.createDataFrame([(1, "a text", 2**31, "extra")], "id bigint, text string, likes bigint, extra string")
    wide, narrow = cf.conform(rows).first(), cf.conform_batch(rows).first()
    assert wide.id == "1" and wide.likes == 2**31 and wide.title is None
    assert narrow.likes is None and cf.conform_batch(rows).columns == schemas.BATCH.names
    assert rows.filter(cf.unreadable(rows, schemas.BATCH)).count() == 1 and rows.filter(cf.unreadable(rows)).count() == 0


def test_length_filter_is_strict(spark):
    rows = spark.createDataFrame([("x" * 10,), ("x" * 11,), (None,)], "text string")
    assert cleaning.clean_posts(rows).count() == 1


def test_pseudonyms_are_stable_and_keep_null(spark):
    rows = spark.createDataFrame([("u",), ("u",), (None,)], "author_id string")
    got = [r[0] for r in cleaning.pseudonymize(rows, salt="s").collect()]
    assert got[0] == got[1] != "u" and len(got[0]) == 64 and got[2] is None


def test_labelled_split_and_rename(spark, tmp_path):
    path = str(tmp_path / "labelled")
    spark.createDataFrame([("t", 1, "train"), ("u", 2, "test")], "text string, label int, split string").write.partitionBy(
        "split").parquet(path)
    assert load_labelled(spark, path).count() == 2 and load_labelled(spark, path, "test").first().text == "u"
    assert rename_labels(load_labelled(spark, path)).columns == ["labels", "split"]


def test_split_does_not_depend_on_partitioning(spark):
    keys = spark.range(1000)
    one = {r.id for r in keys.coalesce(1).filter(in_test_split(F.col("id"))).collect()}
    many = {r.id for r in keys.repartition(13).filter(in_test_split(F.col("id"))).collect()}
    assert one == many and 150 < len(one) < 250
