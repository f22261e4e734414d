"""Hourly trends, their chart form, and alerts on sudden change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import timing
from ..settings import LABELS, TREND_DAYS
from .summary import LABEL, _selected


def trends(results: DataFrame, as_of: str, platform: str | None = None, days: int = TREND_DAYS,
           time: str = "processed_at") -> DataFrame:
    """Rows per date, hour and label in the window, in time order."""
    recent = timing.within(_selected(results, platform), time, as_of, days=days)
    hourly = recent.groupBy(F.date_trunc("hour", F.col(time)).alias("at"), F.col(LABEL).alias("label")).agg(
        F.count("*").alias("count")
    )
    return hourly.select(
        timing.day_text(F.col("at")).alias("date"), F.hour("at").alias("hour"), "label", "count"
    ).orderBy("date", "hour", "label")


def trend_pivot(trend: DataFrame) -> DataFrame:
    """One row per hour with a zero-filled column for each label, in time order."""
    columns = [
        F.coalesce(F.sum(F.when(F.col("label") == name, F.col("count"))), F.lit(0)).alias(name) for name in LABELS
    ]
    return trend.groupBy(timing.hour_stamp(F.col("date"), F.col("hour")).alias("hour")).agg(*columns).orderBy("hour")


def trend_extent(pivot: DataFrame) -> DataFrame:
    """First and last hour and the highest value of any series."""
    return pivot.agg(
        F.min("hour").alias("first_hour"),
        F.max("hour").alias("last_hour"),
        F.max(F.greatest(*LABELS)).alias("highest"),
    )


def _hourly_share(results: DataFrame, label: str, time: str) -> DataFrame:
    """Rows per platform and hour, and the share of a label in per cent."""
    return (
        results.groupBy("platform", F.date_trunc("hour", F.col(time)).alias("hour"))
        .agg(F.count("*").alias("rows"), F.count_if(F.col(LABEL) == label).alias("hits"))
        .withColumn("share", F.bround(F.col("hits") / F.col("rows") * 100, 2))
    )


def sentiment_alerts(results: DataFrame, label: str = "negative", min_change: float = 20.0, min_rows: int = 3,
                     time: str = "processed_at") -> DataFrame:
    """Hours in which a label's share moved by at least ``min_change`` points since the hour before it.

    Both hours must have ``min_rows`` rows; across a gap nothing is compared. Hours are counted first, so the
    window runs over one row per platform and hour.
    """
    hourly = _hourly_share(results, label, time)
    in_order = Window.partitionBy("platform").orderBy("hour")
    adjacent = F.lag("hour").over(in_order) == F.col("hour") - F.make_dt_interval(hours=F.lit(1))
    enough = (F.col("rows") >= min_rows) & (F.lag("rows").over(in_order) >= min_rows)
    before = F.when(adjacent & enough, F.lag("share").over(in_order))
    return (
        hourly.withColumn("change", F.bround(F.col("share") - before, 2))
        .filter(F.abs("change") >= min_change)
        .select("platform", "hour", "rows", "share", "change")
    )


def sentiment_zscore_alerts(results: DataFrame, label: str = "negative", hours: int = 24, min_hours: int = 6,
                            threshold: float = 2.0, time: str = "processed_at", digits: int = 6) -> DataFrame:
    """Hours in which a label's share is ``threshold`` deviations or more away from the ``hours`` before it.

    Mean and sample deviation come from sums and sums of squares over the trailing hours that have rows, at least
    ``min_hours`` of them; the hour itself is not among them. Shares are counted in hundredths of a point, so the sums are
    whole numbers and exact. Where all those hours are alike there is no deviation and no alert.
    """
    points = F.round(F.col("share") * 100).cast("long")
    hourly = _hourly_share(results, label, time).withColumn("_points", points)
    hour_number = F.floor(F.unix_seconds(F.col("hour").cast("timestamp")) / 3600)
    before = Window.partitionBy("platform").orderBy("_number").rangeBetween(-hours, -1)
    n, total, squares = F.count("*").over(before), F.sum("_points").over(before), F.sum(F.col("_points") * F.col("_points")).over(before)
    summed = hourly.withColumn("_number", hour_number).withColumns({"hours": n, "_total": total, "_squares": squares})
    spread = F.col("hours") * F.col("_squares") - F.col("_total") * F.col("_total")
    deviation = F.sqrt(spread / (F.col("hours") * (F.col("hours") - 1)))
    score = (F.col("_points") - F.col("_total") / F.col("hours")) / deviation
    return (
        summed.filter((F.col("hours") >= max(min_hours, 2)) & (spread > 0))
        .withColumn("zscore", F.bround(score, digits))
        .filter(F.abs("zscore") >= threshold)
        .select("platform", "hour", "rows", "share", "hours", "zscore")
    )
