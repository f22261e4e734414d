"""Summaries of timing, error and host-metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import timing
from ..settings import TIMING_WINDOW
from .scan import running_index

# The terms that decide whether a failed call is tried again, and its limits.
NETWORK_TERMS = ("timeout", "connection", "network")
RATE_TERMS = ("rate limit", "too many requests")
ACCESS_TERMS = ("unauthorized", "forbidden", "invalid credentials")
MAX_FAILURES = 5
FREE_ATTEMPTS = 3

# Fixed values: (metric column, name in messages, warning above, critical above).
HEALTH_LIMITS = (
    ("cpu_percent", "CPU", 75.0, 90.0),
    ("memory_percent", "memory", 75.0, 90.0),
    ("disk_usage", "disk", 85.0, 95.0),
)

# Health status and the message that goes with it.
HEALTH_MESSAGES = {
    "healthy": "System is running normally",
    "warning": "System has performance warnings",
    "critical": "System has critical issues",
    "error": "Unable to get system metrics",
}


def last_n_timings(timings: DataFrame, n: int = TIMING_WINDOW, tie_break: Sequence[str] = ()) -> DataFrame:
    """The latest ``n`` records over all operations."""
    return timings.orderBy(F.col("timestamp").desc(), *[F.col(c).desc() for c in tie_break]).limit(n)


def op_avg_duration(timings: DataFrame, n: int = TIMING_WINDOW, tie_break: Sequence[str] = (),
                    digits: int = 6) -> DataFrame:
    """Mean duration and number of records per operation among the latest ``n``."""
    return (
        last_n_timings(timings, n, tie_break)
        .groupBy("operation")
        .agg(F.bround(F.avg("duration"), digits).alias("avg_duration"), F.count("*").alias("records"))
    )


def rolling_avg_duration(timings: DataFrame, n: int = TIMING_WINDOW, tie_break: Sequence[str] = (),
                         block: int = 100_000, digits: int = 6) -> DataFrame:
    """Mean of each record and the ``n - 1`` before it of the same operation.

    Records are numbered per operation and cut into blocks of ``block``; the last ``n - 1``
    of a block are repeated at the head of the next, so a frame never leaves its block and
    no task holds a whole operation.
    """
    order = ["timestamp", *tie_break]
    numbered = running_index(timings, ["operation"], order, "position")
    home = F.floor((F.col("position") - 1) / block)
    at_end = (F.col("position") - 1) % block >= block - (n - 1)
    placed = numbered.withColumn("_home", home).withColumn(
        "_block", F.explode(F.when(at_end, F.array(home, home + 1)).otherwise(F.array(home)))
    )
    frame = Window.partitionBy("operation", "_block").orderBy("position").rowsBetween(-(n - 1), 0)
    return (
        placed.withColumn("rolling_avg", F.bround(F.avg("duration").over(frame), digits))
        .filter(F.col("_block") == F.col("_home"))
        .drop("_home", "_block")
    )


def error_key(source: Column, kind: Column) -> Column:
    return F.concat_ws("_", source, kind)


def error_summary(errors: DataFrame, as_of: str, since: str | None = None) -> DataFrame:
    """Keys whose latest error is less than an hour old: lifetime count, latest time and message.

    ``since`` leaves out what happened before the counters were last reset.
    """
    ledger = errors if since is None else errors.filter(F.col("timestamp") >= timing.moment(errors, "timestamp", since))
    latest = F.max(F.struct("timestamp", "message")).alias("latest")
    folded = ledger.groupBy("error_key").agg(F.count("*").alias("count"), latest)
    return folded.select(
        "error_key",
        "count",
        F.col("latest.timestamp").alias("last_occurrence"),
        F.col("latest.message").alias("error_message"),
    ).filter(
        F.col("last_occurrence")
        > timing.moment(errors, "timestamp", as_of) - F.make_dt_interval(hours=F.lit(1))
    )


def should_retry(message: Column, count: Column) -> Column:
    """Whether the failed call may be tried again, given how often its key has failed."""
    said = F.lower(message)

    def mentions(terms: Sequence[str]) -> Column:
        return said.rlike("|".join(terms))

    return (
        F.when(count > MAX_FAILURES, False)
        .when(mentions(NETWORK_TERMS), True)
        .when(mentions(RATE_TERMS), True)
        .when(mentions(ACCESS_TERMS), False)
        .otherwise(count <= FREE_ATTEMPTS)
    )


def retry_decision(errors: DataFrame, tie_break: Sequence[str] = ()) -> DataFrame:
    """Each error with the running count of its key and the decision taken on it."""
    counted = running_index(errors, ["error_key"], ["timestamp", *tie_break], "error_count")
    return counted.withColumn("should_retry", should_retry(F.col("message"), F.col("error_count")))


def error_records(errors: DataFrame, area: str) -> DataFrame:
    """Errors of one area of work as records of one layout, ready to append to the error table."""
    return errors.select(
        F.lit(False).alias("success"),
        F.lit(area).alias("area"),
        F.col("error_key").alias("operation"),
        F.col("message").alias("error"),
        F.col("timestamp"),
    )


def health_status(metrics: DataFrame) -> DataFrame:
    """Status, message and lists of issues and warnings for every host sample."""

    def alert(word: str, name: str, column: str) -> Column:
        return F.concat(F.lit(f"{word} {name} usage: "), F.col(column).cast("string"), F.lit("%"))

    issues = [F.when(F.col(c) > critical, alert("High", name, c)) for c, name, _, critical in HEALTH_LIMITS]
    warnings = [
        F.when((F.col(c) > warning) & (F.col(c) <= critical), alert("Elevated", name, c))
        for c, name, warning, critical in HEALTH_LIMITS
    ]
    messages = F.create_map(*[F.lit(part) for pair in HEALTH_MESSAGES.items() for part in pair])
    sampled = F.coalesce(*[F.col(c) for c, *_ in HEALTH_LIMITS]).isNotNull()
    has_issue, has_warning = F.size("issues") > 0, F.size("warnings") > 0
    return (
        metrics.withColumn("issues", F.array_compact(F.array(*issues)))
        .withColumn("warnings", F.array_compact(F.array(*warnings)))
        .withColumn(
            "status",
            F.when(~sampled, "error").when(has_issue, "critical").when(has_warning, "warning").otherwise("healthy"),
        )
        .withColumn("message", messages[F.col("status")])
    )


def durations(spans: DataFrame, start: str = "started", end: str = "ended") -> DataFrame:
    """Seconds between two times, and the same as clock text."""
    micros = F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))
    seconds = micros / 1_000_000
    return spans.withColumn("duration", seconds).withColumn("duration_text", timing.clock_text(F.col("duration")))


def status_report(metrics: DataFrame, timings: DataFrame, errors: DataFrame, as_of: str,
                  tie_break: Sequence[str] = ()) -> DataFrame:
    """Latest health with its message and lists, operations with their mean seconds, and recent errors.

    One long table of text values; the number of all timed operations is the timing named ``total``.
    """
    latest = metrics.orderBy(F.col("timestamp").desc(), *[F.col(c).desc() for c in tie_break]).limit(1)
    told = {c: F.col(c) for c in ("status", "message")} | {c: F.array_join(c, "; ") for c in ("issues", "warnings")}
    parts = F.inline(F.array(*(F.struct(F.lit(name).alias("name"), value.alias("value")) for name, value in told.items())))
    health = health_status(latest).select(F.lit("health").alias("section"), parts)
    mean = F.bround("avg_duration", 3).cast("decimal(20,3)").cast("string")
    speed = op_avg_duration(timings, tie_break=tie_break).select(F.lit("timing").alias("section"), F.col("operation").alias("name"), mean.alias("value"))
    total = last_n_timings(timings, tie_break=tie_break).agg(F.count("*").cast("string").alias("value"))
    speed = speed.unionByName(total.select(F.lit("timing").alias("section"), F.lit("total").alias("name"), "value"))
    failed = error_summary(errors, as_of).select(
        F.lit("error").alias("section"), F.col("error_key").alias("name"), F.col("count").cast("string").alias("value")
    )
    return health.unionByName(speed).unionByName(failed)
