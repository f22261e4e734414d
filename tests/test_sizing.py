import pytest
from pyspark.sql import functions as F

from moodtide.operators import cleaning, enrich
from moodtide import settings
from moodtide.operators.sizing import each, is_small, lookup_join, salted_lookup, widened


def hot_rows(spark):
    """A third of the rows are copies under one key, some keys are null."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 40).cast("string"))
    return spark.range(0, 900, 1, 6).select(key.alias("k"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("v"))


def lookup(spark):
    return spark.range(0, 60, 2).select(F.col("id").cast("string").alias("k"), (F.col("id") * 10).alias("x")).union(
        spark.createDataFrame([("hot", -1)], "k string, x bigint")
    )


def bag(df, columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("how", ["left", "inner", "left_anti"])
def test_salting_changes_no_row(spark, how):
    rows, other = hot_rows(spark), lookup(spark)
    columns = ["k", "v"] if how == "left_anti" else ["k", "v", "x"]
    salted = salted_lookup(rows, other, ["k"], how, hot_rows=100)
    assert bag(salted, columns) == bag(rows.join(other, ["k"], how), columns)


def test_hot_key_is_spread_even_if_its_rows_are_copies(spark):
    parts = hot_rows(spark).filter("k = 'hot'").select(F.pmod(F.xxhash64("v", F.spark_partition_id()), F.lit(8)))
    assert parts.distinct().count() > 1


def test_lookup_is_small_within_both_bounds(spark, monkeypatch):
    small = spark.range(10).withColumn("x", F.lit("y"))
    assert is_small(small)
    monkeypatch.setattr(settings, "LOOKUP_ROW_BOUND", 5)
    assert not is_small(small)
    monkeypatch.setattr(settings, "LOOKUP_ROW_BOUND", 50)
    monkeypatch.setattr(settings, "LOOKUP_BYTE_BOUND", 50)
    assert not is_small(small)


@pytest.mark.parametrize("how", ["left", "inner", "left_anti"])
def test_large_lookup_gives_the_same_rows(spark, monkeypatch, how):
    rows, other = hot_rows(spark), lookup(spark)
    columns = ["k", "v"] if how == "left_anti" else ["k", "v", "x"]
    small = bag(lookup_join(rows, other, ["k"], how), columns)
    monkeypatch.setattr(settings, "LOOKUP_ROW_BOUND", 5)
    monkeypatch.setattr(settings, "HOT_KEY_ROWS", 100)
    large = lookup_join(rows, other, ["k"], how)
    assert "_salt" in large._jdf.queryExecution().analyzed().toString()
    assert bag(large, columns) == small


def test_each_drops_nothing_but_empty_arrays(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "n int, xs array<string>")
    assert bag(each(rows, F.col("xs"), "n", name="x"), ["n", "x"]) == [(1, "a"), (1, "b")]


def test_only_short_scans_are_spread(spark):
    assert widened(spark.range(0, 100, 1, 2)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert widened(spark.range(0, 100, 1, 64)).rdd.getNumPartitions() == 64


def test_spam_counts_copies_of_a_hot_text(spark):
    posts = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "copy").otherwise(F.col("id").cast("string")).alias("text"))
    got = cleaning.spam_flags(posts)
    assert got.filter("is_spam").count() == 100 and got.filter("repeats_over_limit = 100").count() == 100 and got.count() == 300


def test_dedup_keeps_latest_and_rows_without_id(spark):
    rows = [("a", "x", "t1", "2024-01-01 00:00:00"), ("a", "x", "t2", "2024-01-01 01:00:00"), ("b", "x", "t", "2024-01-01 00:00:00"),
            (None, "x", "p", "2024-01-01 00:00:00"), (None, "x", "q", "2024-01-01 00:00:00")]
    posts = spark.createDataFrame(rows, "id string, platform string, text string, collected_at string")
    assert bag(cleaning.dedup_posts(posts), ["id", "text"]) == [("a", "t2"), ("b", "t"), (None, "p"), (None, "q")]
    assert cleaning.distinct_rows(posts.union(posts)).count() == 5


def test_enrichment_takes_the_latest_post_once(spark):
    results = spark.createDataFrame([("x", "1", "r1"), ("x", "1", "r2"), ("x", "9", "r3")], "platform string, post_id string, r string")
    posts = spark.createDataFrame(
        [("x", "1", "en", "u", 1, "2024-01-01", "t"), ("x", "1", "de", "u", 2, "2024-01-02", "t")],
        "platform string, id string, lang string, author_id string, likes int, collected_at string, text string",
    )
    assert bag(enrich.enriched_results(results, posts), ["r", "lang", "likes"]) == [("r1", "de", 2), ("r2", "de", 2)]
    assert bag(enrich.unprocessed_posts(posts, results.filter("post_id = '9'")), ["id"]) == [("1",), ("1",)]
