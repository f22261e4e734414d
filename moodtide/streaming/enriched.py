"""Results joined to the raw posts they came from while both are still arriving, and what came too late for that."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.enrich import enriched_results
from .flows import LATENESS, dedup_stream

#: How long after its collection a post may still be scored and find it in state.
WITHIN = "6 hours"
_FROM_POST = ("lang", "author_id", "likes")


def enriched_stream(
    results: DataFrame, posts: DataFrame, within: str = WITHIN, lateness: str = LATENESS, salts: int = 16
) -> DataFrame:
    """Each result with its post, ``matched`` telling whether the post was there.

    Both sides have a watermark (``processed_at``, ``collected_at``) and the join a time range: a result is made at or
    after its post was collected, and within the given span. So a post leaves the state once results that old are past
    the watermark, a result leaves it when no post can match it any more, and is then given out unmatched. Of a post
    that is collected several times the first arrival counts. Late rows of either side are left to ``completed``.
    """
    found = dedup_stream(posts.select("platform", "id", "collected_at", *_FROM_POST), lateness, salts)
    right = found.select(F.col("platform").alias("_platform"), F.col("id").alias("_id"), "collected_at", *_FROM_POST)
    left = results.withColumn("processed_at", F.col("processed_at").cast("timestamp")).withWatermark("processed_at", lateness)
    same = (
        (F.col("platform") == F.col("_platform"))
        & (F.col("post_id") == F.col("_id"))
        & (F.col("processed_at") >= F.col("collected_at"))
        & (F.col("processed_at") <= F.col("collected_at") + F.expr(f"INTERVAL {within}"))
    )
    joined = left.join(right, same, "left")
    return joined.withColumn("matched", F.col("_id").isNotNull()).drop("_platform", "_id", "collected_at")


def completed(joined: DataFrame, results: DataFrame, posts: DataFrame) -> DataFrame:
    """What the stream wrote, with ``outcome``: joined in the stream, ``late`` where the tables show the match, or ``missing``.

    ``results`` and ``posts`` are the stored tables, posts with their text. Results that the stream dropped as too late are among the stored
    ones and come out as well; only what was not joined in time is joined again.
    """
    in_time = joined.filter("matched").select(*results.columns, *_FROM_POST)
    keys = ["platform", "post_id", "processed_at"]
    times = F.col("processed_at").cast("timestamp")
    done = in_time.select(*keys).distinct()
    rest = results.withColumn("processed_at", times).join(done, keys, "left_anti")
    late = enriched_results(rest, posts)
    known = posts.select("platform", F.col("id").alias("post_id")).distinct()
    missing = rest.join(known, ["platform", "post_id"], "left_anti")
    for name in _FROM_POST:
        missing = missing.withColumn(name, F.lit(None).cast(in_time.schema[name].dataType))
    parts = [frame.withColumn("outcome", F.lit(outcome)) for frame, outcome in ((in_time, "joined"), (late, "late"), (missing, "missing"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
