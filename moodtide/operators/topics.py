"""Trending hashtags and mentions, and keyword matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from .sizing import each


def _frequent(tags: DataFrame, tag: str, min_mentions: int) -> DataFrame:
    return (
        tags.groupBy(tag)
        .agg(F.count("*").alias("count"))
        .filter((F.col("count") >= min_mentions) & (F.col(tag) != ""))
        .orderBy(F.col("count").desc(), F.col(tag).asc())
    )


def trending_hashtags(posts: DataFrame, min_mentions: int = 5) -> DataFrame:
    """Tags by how many posts have them as their first tag, the most used first."""
    return _frequent(posts.select(tx.first_hashtag(F.col("text")).alias("hashtag")), "hashtag", min_mentions)


def trending_hashtags_all(posts: DataFrame, min_mentions: int = 5) -> DataFrame:
    """Tags by how often they occur anywhere in a post."""
    return _frequent(each(posts, tx.all_hashtags(F.col("text")), name="hashtag"), "hashtag", min_mentions)


def trending_mentions(posts: DataFrame, min_mentions: int = 5) -> DataFrame:
    return _frequent(each(posts, tx.all_mentions(F.col("text")), name="mention"), "mention", min_mentions)
