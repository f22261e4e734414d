"""Time windows relative to an explicit moment, and timestamp parsing and formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def moment(df: DataFrame, column: str, as_of: str) -> Column:
    """``as_of`` as a literal of the column's own timestamp type, so no cast hides the column."""
    return F.lit(as_of).cast(df.schema[column].dataType)


def within(df: DataFrame, column: str, as_of: str, days: int = 0, hours: int = 0) -> DataFrame:
    """Rows not older than the window; null times fall out and there is no upper bound."""
    return df.filter(F.col(column) >= moment(df, column, as_of) - _span(days, hours))


def older_than(df: DataFrame, column: str, as_of: str, days: int = 0, hours: int = 0) -> Column:
    return F.col(column) < moment(df, column, as_of) - _span(days, hours)


def _span(days: int, hours: int) -> Column:
    return F.make_dt_interval(F.lit(days), F.lit(hours))


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def from_iso(text: Column) -> Column:
    """ISO-8601 text, ``Z`` or offset included; unreadable text gives null."""
    return F.try_to_timestamp(text)


def to_iso(stamp: Column) -> Column:
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")


def day_text(stamp: Column) -> Column:
    return F.date_format(stamp, "yyyy-MM-dd")


def hour_stamp(day: Column, hour: Column) -> Column:
    """Date text and hour number joined to the start of that hour."""
    return F.to_timestamp(F.concat(day, F.lit(" "), F.lpad(hour.cast("string"), 2, "0")), "yyyy-MM-dd HH")


def clock_text(seconds: Column) -> Column:
    """Elapsed whole seconds as ``H:MM:SS``, with days in front from one day on."""
    whole = F.floor(seconds)
    days = F.floor(whole / 86400)
    clock = F.format_string(
        "%d:%02d:%02d", F.floor(whole % 86400 / 3600), F.floor(whole % 3600 / 60), (whole % 60).cast("long")
    )
    label = F.when(days == 1, F.lit(" day, ")).otherwise(F.lit(" days, "))
    return F.when(days > 0, F.concat(days.cast("string"), label, clock)).otherwise(clock)
