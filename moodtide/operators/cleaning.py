"""Row filters, post metadata and duplicate removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.hashing import content_key
from ..settings import MIN_TEXT_LENGTH
from .ranking import top_k_per_group
from .sizing import salted_lookup


def clean_posts(posts: DataFrame, min_length: int = MIN_TEXT_LENGTH) -> DataFrame:
    """Posts with a text longer than ``min_length`` characters."""
    return posts.filter(F.col("text").isNotNull() & (F.length("text") > min_length))


def post_metadata(posts: DataFrame, as_of: str | None = None) -> DataFrame:
    """Processing time, text length and word count beside every post."""
    stamp = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    return posts.withColumns(
        {
            "processing_time": stamp,
            "text_length": F.length("text"),
            "word_count": tx.word_count(F.col("text")),
        }
    )


def text_fallback(posts: DataFrame) -> DataFrame:
    """Text, else title, else description; posts with none of them are left out."""
    chosen = tx.first_filled(F.col("text"), F.col("title"), F.col("description"))
    return posts.withColumn("text", chosen).filter(F.col("text").isNotNull())


def english_only(posts: DataFrame) -> DataFrame:
    return posts.filter(F.col("lang") == "en")


def distinct_rows(posts: DataFrame) -> DataFrame:
    """Rows that differ in at least one column, collection time included."""
    return posts.distinct()


def dedup_posts(posts: DataFrame, tie_breaks: Sequence[str] = ("text",)) -> DataFrame:
    """One row per ``(platform, id)``: the one collected last. Rows without an id are told apart by content.

    Of rows that are alike in time and tie breaks the one with the least hash of all columns stays.
    """
    order = [F.col("collected_at").desc(), *[F.col(c).asc() for c in tie_breaks], F.col("_last").asc()]
    own = F.when(F.col("id").isNull(), content_key(posts.columns))
    marked = posts.withColumns({"_own": own, "_last": F.xxhash64(*posts.columns)})
    return top_k_per_group(marked, ["platform", "id", "_own"], order, 1).drop("_own", "_last")


def pseudonymize(posts: DataFrame, columns: Sequence[str] = ("author_id", "author"), salt: str = "") -> DataFrame:
    """Author columns replaced by a salted SHA-256; null stays null."""
    return posts.withColumns(
        {c: F.sha2(F.concat(F.lit(salt), F.col(c)), 256) for c in columns if c in posts.columns}
    )


def spam_flags(posts: DataFrame, key: str = "id", max_marks: float = 0.5, max_repeats: int = 3) -> DataFrame:
    """Posts that are mostly links, tags and mentions, or whose text is repeated too often.

    Only texts that do repeat too often enter the join, and a text copied very many times
    is spread over several tasks.
    """
    marks = F.regexp_count("text", F.lit(r"http\S+|www\S+|@\w+|#\w+"))
    measured = posts.select(
        key,
        (marks / F.greatest(tx.word_count(F.col("text")), F.lit(1))).alias("mark_ratio"),
        F.md5("text").alias("text_hash"),
    )
    repeated = (
        posts.groupBy(F.md5("text").alias("text_hash"))
        .count()
        .filter(F.col("count") > max_repeats)
    )
    lookup = repeated.withColumnRenamed("count", "copies")
    joined = salted_lookup(measured, lookup, ["text_hash"], "left", [key], sizes=repeated)
    return joined.select(
        key,
        "mark_ratio",
        F.coalesce("copies", F.lit(0)).alias("repeats_over_limit"),
        ((F.col("mark_ratio") > max_marks) | F.col("copies").isNotNull()).alias("is_spam"),
    )


def has_sentiment() -> Column:
    """False for a scored record whose sentiment part is missing."""
    return F.col("sentiment").isNotNull()
