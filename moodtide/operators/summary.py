"""Label summaries, platform overviews and volumes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import timing
from ..functions.labels import js_round, percentage
from ..settings import DAILY_POST_TARGET, HIGH_CONFIDENCE, LABELS, PLATFORMS, SUMMARY_HOURS
from .sizing import small_table

LABEL = "sentiment.label"


def _selected(results: DataFrame, platform: str | None) -> DataFrame:
    return results.filter(F.col("platform") == platform) if platform else results


def _count(label: str, column: Column) -> Column:
    return F.count_if(column == label)


def label_share(counts: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Percent of the scope's total beside each label count, known labels zero-filled.

    ``counts`` holds one row per scope and label, so the window is over a handful of rows.
    """
    total = F.sum("count").over(Window.partitionBy(*scope))
    return counts.withColumn("total", total).withColumn("percentage", percentage(F.col("count"), F.col("total")))


def _zero_labels(df: DataFrame, scopes: Sequence[str] | None = None) -> DataFrame:
    if scopes is None:
        return small_table(df.sparkSession, [(label, 0) for label in LABELS], ["label", "count"])
    rows = [(scope, label, 0) for scope in scopes for label in LABELS]
    return small_table(df.sparkSession, rows, ["scope", "label", "count"])


def sentiment_summary(results: DataFrame, as_of: str, platform: str | None = None,
                      hours: int = SUMMARY_HOURS) -> DataFrame:
    """Count and share of every label in the window, unknown and null labels included."""
    recent = timing.within(_selected(results, platform), "processed_at", as_of, hours=hours)
    counts = recent.groupBy(F.col(LABEL).alias("label")).count()
    filled = counts.unionByName(_zero_labels(results)).groupBy("label").agg(F.sum("count").alias("count"))
    return label_share(filled)


def batch_stats(results: DataFrame) -> DataFrame:
    """One row of rounded shares of the three labels; a missing label counts as neutral."""
    label = F.coalesce(F.col(LABEL), F.lit("neutral"))
    scored = results.filter(F.col("sentiment").isNotNull())
    counted = scored.agg(*[_count(name, label).alias(name) for name in LABELS])
    total = sum((F.col(name) for name in LABELS[1:]), F.col(LABELS[0]))
    return counted.withColumn("total", total).select(
        *[percentage(F.col(name), F.col("total")).alias(name) for name in LABELS], "total"
    )


def analyzer_summary(results: DataFrame) -> DataFrame:
    """One row of unrounded shares of all rows; a label outside the three is an error."""
    label = F.coalesce(F.col(LABEL), F.lit("neutral"))
    checked = F.when(label.isin(*LABELS), label).otherwise(
        F.raise_error(F.concat(F.lit("unknown label: "), label)).cast("string")
    )
    counted = results.agg(*[_count(name, checked).alias(name) for name in LABELS], F.count("*").alias("total"))
    return counted.select(*[percentage(F.col(n), F.col("total"), None).alias(n) for n in LABELS], "total")


def platform_counts(results: DataFrame) -> DataFrame:
    """Rows per platform and label: the small table the overviews are folded from."""
    return results.groupBy("platform", F.col(LABEL).alias("label")).count()


def overview_stats(results: DataFrame, as_of: str, hours: int = SUMMARY_HOURS,
                   platforms: Sequence[str] = PLATFORMS) -> DataFrame:
    """Summary of the window overall and for each platform, from one pass over the rows.

    The overall rows include platforms outside the list.
    """
    counts = platform_counts(timing.within(results, "processed_at", as_of, hours=hours))
    own = F.when(F.col("platform").isin(*platforms), F.col("platform"))
    scoped = counts.select(
        F.explode(F.array_compact(F.array(F.lit("overall"), own))).alias("scope"), "label", "count"
    )
    filled = (
        scoped.unionByName(_zero_labels(results, ["overall", *platforms]))
        .groupBy("scope", "label")
        .agg(F.sum("count").alias("count"))
    )
    return label_share(filled, ["scope"])


def platform_breakdown(results: DataFrame, as_of: str, hours: int = SUMMARY_HOURS) -> DataFrame:
    """One row per platform that has data: its label shares to one decimal, and its total."""
    overview = overview_stats(results, as_of, hours).filter((F.col("scope") != "overall") & (F.col("total") > 0))
    shares = [F.max(F.when(F.col("label") == n, F.bround("percentage", 1))).alias(n) for n in LABELS]
    return overview.groupBy(F.col("scope").alias("platform")).agg(*shares, F.max("total").alias("total"))


def summary_counts(summary: DataFrame) -> DataFrame:
    """Label counts worked back from the rounded shares, as the display does."""
    return summary.filter(F.col("label").isin(*LABELS)).select(
        "label", js_round(F.col("total") * F.col("percentage") / 100).alias("approx_count")
    )


def distribution_labels(summary: DataFrame, min_percentage: float = 5.0) -> DataFrame:
    """Chart captions: one-decimal share, blank for a slice too small to carry one."""
    caption = F.when(
        F.col("percentage") > min_percentage, F.concat(F.format_number("percentage", 1), F.lit("%"))
    ).otherwise("")
    return summary.filter(F.col("label").isin(*LABELS)).select("label", caption.alias("caption"))


def high_confidence(results: DataFrame, threshold: float = HIGH_CONFIDENCE) -> DataFrame:
    return results.filter(F.col("sentiment.confidence") >= threshold)


def filtered_summary(results: DataFrame, start: str, end: str, platform: str | None = None,
                     keyword: str | None = None) -> DataFrame:
    """Label shares in a closed-open date range, for a platform and a tracked keyword if given."""
    at = F.col("processed_at")
    chosen = _selected(results, platform).filter(
        (at >= timing.moment(results, "processed_at", start)) & (at < timing.moment(results, "processed_at", end))
    )
    if keyword is not None:
        chosen = chosen.filter(F.array_contains("keywords", keyword))
    return label_share(chosen.groupBy(F.col(LABEL).alias("label")).count())


def daily_volume(posts: DataFrame, target: int = DAILY_POST_TARGET, time: str = "collected_at") -> DataFrame:
    """Posts per day and whether the daily target was met."""
    counted = posts.groupBy(F.to_date(time).alias("day")).agg(F.count("*").alias("posts"))
    return counted.select(
        timing.day_text(F.col("day")).alias("day"), "posts", (F.col("posts") >= target).alias("target_met")
    )


def topic_platform_daily(results: DataFrame, time: str = "processed_at") -> DataFrame:
    """Rows per tracked keyword, platform, day and label."""
    counted = (
        results.select(
            F.explode("keywords").alias("keyword"), "platform", F.to_date(time).alias("day"), F.col(LABEL).alias("label")
        )
        .groupBy("keyword", "platform", "day", "label")
        .agg(F.count("*").alias("count"))
    )
    return counted.withColumn("day", timing.day_text(F.col("day")))


def cycle_counts(collected: DataFrame, kept: Column, scored: Column, cycle: Column) -> DataFrame:
    """Rows collected, kept and scored per cycle and platform."""
    return collected.groupBy(cycle.alias("cycle"), "platform").agg(
        F.count("*").alias("collected"), F.count_if(kept).alias("kept"), F.count_if(scored).alias("scored")
    )
