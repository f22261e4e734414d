"""Recent, top and latest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx, timing
from ..settings import LABELS, PREVIEW_LENGTH, SUMMARY_HOURS
from .sizing import spread


def top_k_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str | None = None,
    salts: int = 64,
) -> DataFrame:
    """The first ``k`` rows of every group; ``order`` must end in a unique column.

    Up to the optimizer's own threshold each task keeps only ``k`` rows a group before the
    shuffle. Beyond it the group is first cut inside ``salts`` parts, so that no task ever
    sorts a whole hot group.
    """
    number = rank or "_rank"
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > threshold:
        part = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = (
            df.withColumn("_part", spread([c for c in df.columns if c not in keys], salts))
            .withColumn("_rank", F.row_number().over(part))
            .filter(F.col("_rank") <= k)
            .drop("_rank", "_part")
        )
    ranked = df.withColumn(number, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(number) <= k)
    return kept if rank else kept.drop(number)


def recent_posts(posts: DataFrame, as_of: str, platform: str | None = None, hours: int = SUMMARY_HOURS,
                 limit: int = 1000) -> DataFrame:
    """Newest posts of the window; ties in time are ordered by id."""
    return (
        timing.within(_of_platform(posts, platform), "created_at", as_of, hours=hours)
        .orderBy(F.col("created_at").desc(), F.col("id").asc())
        .limit(limit)
    )


def recent_posts_view(recent: DataFrame) -> DataFrame:
    """Display columns of recent posts, with text and author fallbacks and zeroed metrics."""
    metrics = F.struct(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("likes", "retweets", "score")])
    return recent.select(
        "id",
        tx.first_filled(F.col("text"), F.col("title")).alias("text"),
        "platform",
        timing.to_iso(F.col("created_at")).alias("created_at"),
        tx.first_filled(F.col("author_id"), F.col("author")).alias("author"),
        metrics.alias("metrics"),
    )


def top_posts(results: DataFrame, label: str, platform: str | None = None, limit: int = 10) -> DataFrame:
    """Most confident results of a label, over all time; later ones first among equals."""
    return (
        _of_platform(results, platform)
        .filter(F.col("sentiment.label") == label)
        .orderBy(*_by_confidence())
        .limit(limit)
    )


def top_posts_per_label(results: DataFrame, k: int = 5, labels: Sequence[str] = LABELS) -> DataFrame:
    """The ``k`` most confident results of each label in one pass, with their rank."""
    labelled = results.withColumn("label", F.col("sentiment.label")).filter(F.col("label").isin(*labels))
    return top_k_per_group(labelled, ["label"], _by_confidence(), k, rank="rank")


def top_posts_view(top: DataFrame) -> DataFrame:
    """Display columns of top posts: preview text, ISO time, one-decimal confidence."""
    return top.select(
        F.col("post_id").cast("string").alias("id"),
        tx.ellipsize(F.col("text"), PREVIEW_LENGTH).alias("text"),
        "platform",
        "sentiment",
        timing.to_iso(F.col("created_at")).alias("created_at"),
        F.concat(F.format_number(F.col("sentiment.confidence") * 100, 1), F.lit("%")).alias("confidence_text"),
        "metadata",
    )


def samples_per_label(labelled: DataFrame, k: int = 3, label: str = "label", row: str = "row_id") -> DataFrame:
    """The first ``k`` rows of each label in row order."""
    return top_k_per_group(labelled, [label], [F.col(row).asc()], k, rank="sample")


def first_rows(df: DataFrame, order: str, n: int = 6) -> DataFrame:
    """The first ``n`` rows in the order of a unique column."""
    return df.orderBy(F.col(order).asc()).limit(n)


def _by_confidence() -> list[Column]:
    return [F.col("sentiment.confidence").desc(), F.col("processed_at").desc(), F.col("post_id").asc()]


def _of_platform(df: DataFrame, platform: str | None) -> DataFrame:
    return df.filter(F.col("platform") == platform) if platform else df
