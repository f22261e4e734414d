"""Phrase matching of any length and keyword lists with versions."""

import re
import time

import pytest
from pyspark.sql import functions as F

from moodtide.sources import keywords as kw


def spoken(text):
    return " " + " ".join(re.findall(r"[^\W_]+", (text or "").lower())) + " "


LONG = " ".join(f"w{i % 37} q{i}" for i in range(100))
POSTS = [
    ("1", f"so it goes: {LONG}! and on"), ("2", f"{LONG[:-1]}"), ("3", "to be or not to be, that is the question"), ("4", None), ("5", ""),
    ("6", "To be, or not to be that"), ("7", "be or not"), (None, "to be or not to be that is"), ("3", "other text under the same id"),
    ("3", "to be or not to be, that is the question"), ("8", "x " * 30_000 + "the very end of it all"),
]
TRACKED = [
    LONG, "to be", "to be or not to be", "or not to", "question", "not to be that is the question", "be or not to be that", "", "  ", None,
    "the very end of it", "x x x x x x", "to be to be to be to be", "To Be",
]


def frames(spark, posts=POSTS, tracked=TRACKED):
    return spark.createDataFrame(posts, "id string, text string"), spark.createDataFrame([(t,) for t in tracked], "keyword string")


def plain(posts, tracked):
    wanted = {t for t in tracked if t is not None and spoken(t).strip()}
    return sorted(((i, t) for i, text in posts for t in wanted if spoken(t) in spoken(text)), key=str)


@pytest.mark.parametrize("tracked", [TRACKED, [t for t in TRACKED if t and len(t.split()) <= 3], [t for t in TRACKED if t and len(t.split()) > 3], [None, " "], []])
def test_phrases_of_all_lengths(spark, tracked):
    posts, table = frames(spark, tracked=tracked)
    assert sorted(map(tuple, kw.match_keyword_table(posts, table).collect()), key=str) == plain(POSTS, tracked)


def test_lookups_that_are_not_small_give_the_same(spark, monkeypatch):
    from moodtide import settings

    monkeypatch.setattr(settings, "LOOKUP_ROW_BOUND", 1)
    posts, table = frames(spark)
    assert sorted(map(tuple, kw.match_keyword_table(posts, table).collect()), key=str) == plain(POSTS, TRACKED)


def test_phrases_are_not_moved_with_their_runs(spark, monkeypatch):
    """What is written on the way is a few short columns beside each phrase once."""
    seen = []
    written = kw._written
    monkeypatch.setattr(kw, "_written", lambda df, name: seen.append((name, df.columns)) or written(df, name))
    posts, table = frames(spark, tracked=[t for t in TRACKED if t and len(t.split()) > 3])
    assert kw.match_keyword_table(posts, table).count()
    assert dict(seen) == {"phrases": ["_phrase", "phrase"], "phrase-index": ["run", "_phrase", "_back", "_length"], "phrase-candidates": ["_node", "_may"], "phrases-said": ["id", "_phrase"]}


def plan_size(spark, words):
    posts, table = frames(spark, tracked=[" ".join(f"p{i}" for i in range(words))])
    return kw.match_keyword_table(posts, table)._jdf.queryExecution().analyzed().toString().count("\n")


def test_the_plan_does_not_grow_with_the_phrase(spark):
    assert plan_size(spark, 200) == plan_size(spark, 5)


def test_a_hundred_thousand_phrases(spark):
    table = spark.range(100_000).select(F.concat(F.lit("some common words before the number "), F.col("id").cast("string")).alias("keyword"))
    posts, _ = frames(spark, [(str(i), f"here are some common words before the number {i * 1000} and more") for i in range(20)])
    began = time.perf_counter()
    got = {r.id: r.keyword for r in kw.match_keyword_table(posts, table).collect()}
    assert got == {str(i): f"some common words before the number {i * 1000}" for i in range(20)}
    assert time.perf_counter() - began < 60


def test_a_post_is_matched_by_the_list_of_its_time(spark):
    versions = spark.createDataFrame(
        [("x", "2024-01-02", ["tea", "green tea"]), ("x", "2024-01-05", ["coffee"]), ("y", "2024-01-01", [])],
        "platform string, since string, keywords array<string>",
    ).select("platform", F.col("since").cast("timestamp").alias("valid_from"), "keywords")
    rows = [("1", "x", "Green tea!", "2024-01-01"), ("2", "x", "Green tea!", "2024-01-02"), ("3", "x", "tea and coffee", "2024-01-04 23:59:59"),
            ("4", "x", "tea and coffee", "2024-01-05"), ("5", "y", "tea", "2024-01-09"), ("6", "z", "tea", "2024-01-09"), ("7", "x", None, None)]
    posts = spark.createDataFrame(rows, "id string, platform string, text string, at string")
    got = kw.keywords_as_of(posts.withColumn("created_at", F.col("at").cast("timestamp")), versions)
    assert {r.id: r.matched for r in got.collect()} == {"1": [], "2": ["tea", "green tea"], "3": ["tea"], "4": ["coffee"], "5": [], "6": [], "7": []}
