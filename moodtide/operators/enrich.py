"""Joins between posts, comments, video counters and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .cleaning import dedup_posts
from .sizing import salted_lookup


def post_comment_counts(posts: DataFrame, comments: DataFrame, post_key: str = "id",
                        parent: str = "parent_id") -> DataFrame:
    """Comments of every post, zero where there are none.

    Comments are counted before they are joined, so a much-discussed post is one row; a post
    that is held very many times is spread over several tasks.
    """
    counted = comments.groupBy(F.col(parent).alias(post_key)).agg(F.count("*").alias("comments"))
    return salted_lookup(posts, counted, [post_key]).withColumn("comments", F.coalesce("comments", F.lit(0)))


def video_engagement(videos: DataFrame, stats: DataFrame) -> DataFrame:
    """Counters beside each video and its likes and comments per view.

    Of several snapshots of a video's counters the one with the most views is taken: they only grow.
    """
    newest = F.max(F.struct("views", "likes", "comments")).alias("_c")
    stats = stats.groupBy("video_id").agg(newest).select("video_id", "_c.*")
    rate = F.when(F.col("views") > 0, F.bround((F.col("likes") + F.col("comments")) / F.col("views") * 100, 2))
    counters = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("views", "likes", "comments")}
    return (
        videos.join(stats, videos["id"] == stats["video_id"], "left")
        .drop("video_id")
        .withColumns(counters)
        .withColumn("engagement", rate)
    )


def enriched_results(results: DataFrame, posts: DataFrame) -> DataFrame:
    """Results with the latest raw post they came from; results without one are left out.

    A post scored very many times is spread over several tasks.
    """
    latest = dedup_posts(posts).select(
        "platform", F.col("id").alias("post_id"), F.col("lang"), F.col("author_id"), F.col("likes")
    )
    return salted_lookup(results, latest, ["platform", "post_id"], "inner")


def unprocessed_posts(posts: DataFrame, results: DataFrame) -> DataFrame:
    """Posts that no result refers to yet; a post held very many times is spread over several tasks."""
    done = results.select("platform", F.col("post_id").alias("id")).distinct()
    return salted_lookup(posts, done, ["platform", "id"], "left_anti")
