"""Normalisers from landed API records to the post and comment layouts.

Each takes the parsed records of one source, from a batch or a stream, and is row-local
unless a cap is asked for, so it scales with the files. ``collected_at`` is a column the
caller stamps at landing time, or a literal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import timing
from ..operators.ranking import top_k_per_group
from ..operators.sizing import each
from ..settings import DEFAULT_KEYWORDS
from .keywords import matched_keywords


def read_landed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON-lines files with a given schema; an unreadable line is kept as ``_corrupt_record``."""
    return _parsed(spark.read.text(path), schema)


def stream_landed(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    return _parsed(spark.readStream.options(**options).text(path), schema)


def _parsed(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Lines parsed by expression: the JSON reader refuses to count the unreadable lines alone."""
    whole = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return lines.select(F.from_json("value", whole).alias("record")).select("record.*")


def _tracked(keywords: Sequence[str]) -> Column:
    return F.array(*[F.lit(word) for word in keywords])


def normalize_tweets(
    raw: DataFrame,
    collected_at: Column,
    keywords: Sequence[str] = DEFAULT_KEYWORDS,
    max_results: int | None = None,
) -> DataFrame:
    """English posts that match any keyword; a cap applies before the language test."""
    found = raw.filter(F.size(matched_keywords(F.col("text"), keywords)) > 0)
    if max_results is not None:
        found = found.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(max_results)
    return found.filter(F.col("lang") == "en").select(
        F.col("id").cast("string").alias("id"),
        F.lit("twitter").alias("platform"),
        "text",
        timing.from_iso(F.col("created_at")).alias("created_at"),
        collected_at.cast("timestamp").alias("collected_at"),
        "lang",
        F.col("author_id").cast("string").alias("author_id"),
        F.coalesce(F.col("public_metrics.like_count"), F.lit(0)).alias("likes"),
        F.coalesce(F.col("public_metrics.retweet_count"), F.lit(0)).alias("retweets"),
        _tracked(keywords).alias("keywords"),
    )


def normalize_reddit_posts(
    raw: DataFrame,
    collected_at: Column,
    subreddits: Sequence[str],
    keywords: Sequence[str] = DEFAULT_KEYWORDS,
    limit: int | None = None,
) -> DataFrame:
    """Posts of the named sub-forums, once for every keyword that finds them.

    ``limit`` is shared evenly between the keywords of a sub-forum; newest posts win.
    """
    searched = F.concat_ws(" ", F.col("title"), F.col("selftext"))
    found = each(
        raw.filter(F.col("subreddit").isin(*subreddits)),
        matched_keywords(searched, keywords),
        *raw.columns,
        name="matched_keyword",
    )
    if limit is not None:
        found = top_k_per_group(
            found,
            ["subreddit", "matched_keyword"],
            [F.col("created_utc").desc(), F.col("id").asc()],
            limit // len(keywords),
        )
    return found.select(
        "id",
        F.lit("reddit").alias("platform"),
        F.col("selftext").alias("text"),
        "title",
        timing.from_epoch(F.col("created_utc")).alias("created_at"),
        collected_at.cast("timestamp").alias("collected_at"),
        F.coalesce(F.col("author"), F.lit("[deleted]")).alias("author"),
        "subreddit",
        F.col("ups").alias("upvotes"),
        F.col("downs").alias("downvotes"),
        "score",
        "num_comments",
        _tracked(keywords).alias("keywords"),
        "matched_keyword",
    )


def normalize_reddit_comments(raw: DataFrame, collected_at: Column, limit: int | None = None) -> DataFrame:
    """The first ``limit`` comments of every submission (all if not given), in the order they were listed."""
    kept = raw
    if limit is not None:
        kept = top_k_per_group(raw, ["parent_id"], [F.col("position").asc(), F.col("id").asc()], limit)
    return kept.select(
        "id",
        F.lit("reddit").alias("platform"),
        F.col("body").alias("text"),
        timing.from_epoch(F.col("created_utc")).alias("created_at"),
        collected_at.cast("timestamp").alias("collected_at"),
        F.coalesce(F.col("author"), F.lit("[deleted]")).alias("author"),
        "parent_id",
        "score",
    )


def normalize_videos(
    raw: DataFrame,
    collected_at: Column,
    keywords: Sequence[str] = DEFAULT_KEYWORDS,
    limit: int | None = None,
) -> DataFrame:
    """One row per found video; the publication time becomes ``created_at``.

    ``limit`` keeps the first videos of every landed response, which lists them by relevance.
    """
    listed = F.col("items") if limit is None else F.slice("items", 1, limit)
    item = raw.select(F.explode(listed).alias("item"))
    searched = F.concat_ws(" ", F.col("item.snippet.title"), F.col("item.snippet.description"))
    return item.filter(F.size(matched_keywords(searched, keywords)) > 0).select(
        F.col("item.id.videoId").alias("id"),
        F.lit("youtube").alias("platform"),
        F.col("item.snippet.title").alias("title"),
        F.col("item.snippet.description").alias("description"),
        timing.from_iso(F.col("item.snippet.publishedAt")).alias("created_at"),
        collected_at.cast("timestamp").alias("collected_at"),
        F.col("item.snippet.channelTitle").alias("channel"),
        _tracked(keywords).alias("keywords"),
    )


def normalize_video_comments(raw: DataFrame, collected_at: Column, limit: int | None = None) -> DataFrame:
    """One row per top-level comment, in listed order; ``limit`` applies per landed response."""
    listed = F.col("items") if limit is None else F.slice("items", 1, limit)
    comment = raw.select("video_id", F.explode(listed).alias("item")).select(
        "video_id", F.col("item.snippet.topLevelComment").alias("top")
    )
    return comment.select(
        F.col("top.id").alias("id"),
        F.lit("youtube").alias("platform"),
        F.col("top.snippet.textDisplay").alias("text"),
        timing.from_iso(F.col("top.snippet.publishedAt")).alias("created_at"),
        collected_at.cast("timestamp").alias("collected_at"),
        F.col("top.snippet.authorDisplayName").alias("author"),
        "video_id",
        F.col("top.snippet.likeCount").alias("likes"),
    )


def video_stats(raw: DataFrame) -> DataFrame:
    """Text counters as longs, zero where missing or unreadable."""

    def count_of(name: str) -> Column:
        return F.coalesce(F.col(name).try_cast("bigint"), F.lit(0).cast("bigint"))

    return raw.select(
        "video_id",
        count_of("viewCount").alias("views"),
        count_of("likeCount").alias("likes"),
        count_of("commentCount").alias("comments"),
    )
