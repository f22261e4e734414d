"""Error counters as keyed stream state: a running retry decision and the last error of every key.

The state of a key is one row (how often it failed, when last, with which message) and the errors that still wait for
the watermark. It lives in the state store, so a restart goes on counting where it stopped. A key is forgotten by a
timer ``expiry`` after its last error: that is the counters' reset, and bounds the state by the keys of that span.

Errors of a key are decided in the order of their times, not of their arrival: each waits until the watermark has
passed it, and those of one time follow the tie-break. A decision therefore comes ``lateness`` after its error at the
soonest and equals that of the batch query over the whole table. What comes later than that is dropped by the watermark.
A micro-batch reads and writes the waiting rows of a key once, whatever their number; bound a batch with the source's
``maxFilesPerTrigger``, since the errors of one key in one batch are decided by one task. Start these streams with
``keyed_state=True`` (``flows.start``) in a session whose state store is Spark's default one.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.oplog import should_retry
from .flows import LATENESS

_COUNTED = "error_key string, event_id long, at long, message string, error_count long"
_NAMES = [column.split()[0] for column in _COUNTED.split(", ")]


class ErrorCounter(StatefulProcessor):
    """Counts the errors of a key in time order; a quiet span of ``expiry`` microseconds ends the count."""

    def __init__(self, expiry: int | None):
        self.expiry = expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "count long, last long, message string")
        self.waiting = handle.getListState("waiting", "at long, event_id long, message string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Put the errors to those that wait; wake when the watermark has passed the first of them."""
        arrived = [
            (int(at), int(event_id), message)
            for batch in rows
            for at, event_id, message in zip(batch["at"], batch["event_id"], batch["message"], strict=True)
        ]
        self.waiting.appendList(arrived)
        self._wake(min(at for at, *_ in arrived))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Count what the watermark has passed, in order; forget the key if it has been quiet for long."""
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((entry for entry in held if entry[0] < passed), key=lambda entry: entry[:2])
        count, last, message = self.seen.get() if self.seen.exists() else (0, None, None)
        out = []
        for at, event_id, said in due:
            if self.expiry is not None and last is not None and at - last > self.expiry:
                count = 0
            count, last, message = count + 1, at, said
            out.append((key[0], event_id, at, said, count))
        if due:
            later = [entry for entry in held if entry[0] >= passed]
            self.seen.update((count, last, message))
            if later:
                self.waiting.put(later)
                self._wake(min(at for at, *_ in later))
            else:
                self.waiting.clear()
        if self.expiry is not None and last is not None:
            if last + self.expiry < passed and len(due) == len(held):
                self.seen.clear()
            elif due:
                self._wake(last + self.expiry)
        if out:
            yield pd.DataFrame(out, columns=_NAMES)

    def _wake(self, at: int) -> None:
        """A timer for when the watermark has passed this microsecond."""
        self.handle.registerTimer(at // 1000 + 1)

    def close(self) -> None:
        pass


def running_errors(errors: DataFrame, lateness: str = LATENESS, expiry: timedelta | None = None) -> DataFrame:
    """Each error of the stream with the running count of its key: event_id, error_key, timestamp, message, error_count.

    A null key is a key of its own. Rows without a time never pass the watermark and are left out.
    """
    micros = None if expiry is None else expiry // timedelta(microseconds=1)
    timed = errors.select("event_id", "error_key", F.col("timestamp").cast("timestamp").alias("timestamp"), "message")
    keyed = (
        timed.filter(F.col("timestamp").isNotNull())
        .withWatermark("timestamp", lateness)
        .withColumn("at", F.unix_micros("timestamp"))
    )
    counted = keyed.groupBy("error_key").transformWithStateInPandas(
        statefulProcessor=ErrorCounter(micros), outputStructType=_COUNTED, outputMode="Append", timeMode="EventTime"
    )
    return counted.select("event_id", "error_key", F.timestamp_micros("at").alias("timestamp"), "message", "error_count")


def retry_stream(errors: DataFrame, lateness: str = LATENESS, expiry: timedelta | None = None) -> DataFrame:
    """The running count and the decision whether to try again, for each error once it is sure to be in order."""
    counted = running_errors(errors, lateness, expiry)
    return counted.withColumn("should_retry", should_retry(F.col("message"), F.col("error_count")))


def last_errors(decided: DataFrame) -> DataFrame:
    """Of each key the last error and its count since the last reset, from the decided errors as they were written."""
    last = F.max(F.struct("timestamp", "event_id", "error_count", "message")).alias("last")
    return decided.groupBy("error_key").agg(last).select(
        "error_key",
        F.col("last.error_count").alias("count"),
        F.col("last.timestamp").alias("last_occurrence"),
        F.col("last.message").alias("error_message"),
    )
