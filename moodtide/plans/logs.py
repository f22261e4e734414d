"""Queries over timing, error and host-metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import timing
from ..operators import oplog
from . import derived as d
from .derived import sql_iso
from .registry import query

_LAST = "SELECT * FROM timings ORDER BY timestamp DESC, event_id DESC LIMIT 100"
_TIE = ["event_id"]


@query("last_n_timings", f"SELECT event_id, operation, duration FROM ({_LAST})", ("timings",))
def last_n_timings(spark: SparkSession, sf: str) -> DataFrame:
    return oplog.last_n_timings(d.timings(spark, sf), tie_break=_TIE).select("event_id", "operation", "duration")


@query(
    "op_avg_duration",
    f"SELECT operation, round_even(avg(duration), 10) AS avg_duration, count(*) AS records FROM ({_LAST}) GROUP BY operation",
    ("timings",),
)
def op_avg_duration(spark: SparkSession, sf: str) -> DataFrame:
    return oplog.op_avg_duration(d.timings(spark, sf), tie_break=_TIE, digits=10)


@query(
    "rolling_avg_duration",
    """SELECT event_id, operation, row_number() OVER w AS position, round_even(avg(duration) OVER f, 10) AS rolling_avg
       FROM timings WINDOW w AS (PARTITION BY operation ORDER BY timestamp, event_id),
            f AS (PARTITION BY operation ORDER BY timestamp, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""",
    ("timings",),
)
def rolling_avg_duration(spark: SparkSession, sf: str) -> DataFrame:
    rolled = oplog.rolling_avg_duration(d.timings(spark, sf), tie_break=_TIE, digits=10)
    return rolled.select("event_id", "operation", "position", "rolling_avg")


@query(
    "error_summary",
    f"""SELECT error_key, count(*) AS count, {sql_iso('max(timestamp)')} AS last_occurrence,
               arg_max(message, timestamp) AS error_message
        FROM errors GROUP BY error_key HAVING max(timestamp) > TIMESTAMP '2024-01-30 23:30:00' - INTERVAL 1 HOUR""",
    ("errors",),
)
def error_summary(spark: SparkSession, sf: str) -> DataFrame:
    recent = oplog.error_summary(d.errors(spark, sf), "2024-01-30 23:30:00")
    return recent.withColumn("last_occurrence", timing.to_iso(F.col("last_occurrence")))


@query(
    "error_summary_since",
    f"""SELECT error_key, count(*) AS count, {sql_iso('max(timestamp)')} AS last_occurrence,
               arg_max(message, timestamp) AS error_message
        FROM errors WHERE timestamp >= TIMESTAMP '2024-01-30 12:00:00'
        GROUP BY error_key HAVING max(timestamp) > TIMESTAMP '2024-01-30 23:30:00' - INTERVAL 1 HOUR""",
    ("errors",),
)
def error_summary_since(spark: SparkSession, sf: str) -> DataFrame:
    """Recent errors with their counts since the counters were last reset."""
    recent = oplog.error_summary(d.errors(spark, sf), "2024-01-30 23:30:00", since="2024-01-30 12:00:00")
    return recent.withColumn("last_occurrence", timing.to_iso(F.col("last_occurrence")))


@query(
    "retry_decision",
    """SELECT event_id, error_key, error_count,
              CASE WHEN error_count > 5 THEN FALSE
                   WHEN regexp_matches(lower(message), 'timeout|connection|network') THEN TRUE
                   WHEN regexp_matches(lower(message), 'rate limit|too many requests') THEN TRUE
                   WHEN regexp_matches(lower(message), 'unauthorized|forbidden|invalid credentials') THEN FALSE
                   ELSE error_count <= 3 END AS should_retry
       FROM (SELECT *, row_number() OVER (PARTITION BY error_key ORDER BY timestamp, event_id) AS error_count FROM errors)""",
    ("errors",),
)
def retry_decision(spark: SparkSession, sf: str) -> DataFrame:
    return oplog.retry_decision(d.errors(spark, sf), _TIE).select(
        "event_id", "error_key", "error_count", "should_retry"
    )


@query(
    "error_records",
    f"""SELECT FALSE AS success, 'processing' AS area, error_key AS operation, message AS error, {sql_iso('timestamp')} AS timestamp
        FROM errors""",
    ("errors",),
)
def error_records(spark: SparkSession, sf: str) -> DataFrame:
    return oplog.error_records(d.errors(spark, sf), "processing").withColumn(
        "timestamp", timing.to_iso(F.col("timestamp"))
    )


_HEALTH = """SELECT event_id, timestamp, status, message, issues, warnings FROM (
           SELECT *, CASE WHEN cpu_percent IS NULL THEN 'error' WHEN issues <> '' THEN 'critical'
                          WHEN warnings <> '' THEN 'warning' ELSE 'healthy' END AS status,
                  CASE WHEN cpu_percent IS NULL THEN 'Unable to get system metrics' WHEN issues <> '' THEN 'System has critical issues'
                       WHEN warnings <> '' THEN 'System has performance warnings' ELSE 'System is running normally' END AS message
           FROM (SELECT event_id, timestamp, cpu_percent,
                        concat_ws('; ', CASE WHEN cpu_percent > 90 THEN 'High CPU usage: ' || cpu_percent || '%' END,
                                  CASE WHEN memory_percent > 90 THEN 'High memory usage: ' || memory_percent || '%' END,
                                  CASE WHEN disk_usage > 95 THEN 'High disk usage: ' || disk_usage || '%' END) AS issues,
                        concat_ws('; ', CASE WHEN cpu_percent > 75 AND cpu_percent <= 90 THEN 'Elevated CPU usage: ' || cpu_percent || '%' END,
                                  CASE WHEN memory_percent > 75 AND memory_percent <= 90 THEN 'Elevated memory usage: ' || memory_percent || '%' END,
                                  CASE WHEN disk_usage > 85 AND disk_usage <= 95 THEN 'Elevated disk usage: ' || disk_usage || '%' END) AS warnings
                 FROM host_samples))"""


@query(
    "health_status",
    f"SELECT event_id, status, message, issues, warnings FROM ({_HEALTH})",
    ("host_samples",),
)
def health_status(spark: SparkSession, sf: str) -> DataFrame:
    checked = oplog.health_status(d.host_samples(spark, sf))
    lists = {c: F.array_join(c, "; ") for c in ("issues", "warnings")}
    return checked.withColumns(lists).select("event_id", "status", "message", "issues", "warnings")


@query(
    "durations",
    """SELECT event_id, CAST(s AS DOUBLE) AS duration,
              CASE WHEN s >= 172800 THEN (s // 86400) || ' days, ' WHEN s >= 86400 THEN '1 day, ' ELSE '' END
              || (s % 86400 // 3600) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':'
              || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS duration_text
       FROM (SELECT event_id, event_id * 17 AS s FROM events)""",
)
def durations(spark: SparkSession, sf: str) -> DataFrame:
    spans = d.table(spark, sf, "events").select(
        "event_id",
        F.col("ts").alias("started"),
        (F.col("ts") + F.make_dt_interval(secs=F.col("event_id") * 17)).alias("ended"),
    )
    return oplog.durations(spans).select("event_id", F.round("duration", 3).alias("duration"), "duration_text")


@query(
    "status_report",
    f"""SELECT * FROM (WITH latest AS (SELECT * FROM ({_HEALTH}) ORDER BY timestamp DESC, event_id DESC LIMIT 1)
        SELECT 'health' AS section, name, value FROM latest
            UNPIVOT (value FOR name IN (status, message, issues, warnings))
        UNION ALL SELECT 'timing', operation, CAST(CAST(round_even(round_even(avg(duration), 6), 3) AS DECIMAL(20, 3)) AS VARCHAR)
            FROM ({_LAST}) GROUP BY operation
        UNION ALL SELECT 'timing', 'total', CAST(count(*) AS VARCHAR) FROM ({_LAST})
        UNION ALL SELECT 'error', error_key, CAST(count(*) AS VARCHAR) FROM errors GROUP BY error_key
            HAVING max(timestamp) > TIMESTAMP '2024-01-30 23:30:00' - INTERVAL 1 HOUR)""",
    ("host_samples", "timings", "errors"),
)
def status_report(spark: SparkSession, sf: str) -> DataFrame:
    return oplog.status_report(
        d.host_samples(spark, sf), d.timings(spark, sf), d.errors(spark, sf), "2024-01-30 23:30:00", _TIE
    )
