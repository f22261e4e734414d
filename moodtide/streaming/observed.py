"""Counts of each cycle as the stream sees them pass: rows in, kept and scored, without reading any table again."""

from __future__ import annotations

import threading
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

OBSERVED = "cycle_counts"
COUNTS = ("collected", "kept", "scored")
LAYOUT = "run string, batch long, platform string, collected long, kept long, scored long"
_OTHER = "other"


def observed(posts: DataFrame, kept: Column, scored: Column, platforms: Sequence[str]) -> DataFrame:
    """The stream unchanged, with its rows counted by platform in passing; platforms that are not named are ``other``."""
    own = F.col("platform")
    places = {name: own == name for name in platforms} | {_OTHER: ~F.coalesce(own.isin(*platforms), F.lit(False))}
    tests = {"collected": F.lit(True), "kept": kept, "scored": scored}
    counts = [F.count_if(here & test).alias(f"{count}:{place}") for place, here in places.items() for count, test in tests.items()]
    return posts.observe(OBSERVED, *counts)


def _rows(run: str, batch: int, counted: Mapping[str, int]) -> list[tuple]:
    places = dict.fromkeys(name.split(":", 1)[1] for name in counted)
    rows = [(run, batch, place, *(int(counted[f"{count}:{place}"]) for count in COUNTS)) for place in places]
    return [row for row in rows if row[3]]


class CycleListener(StreamingQueryListener):
    """Collects what ``observed`` counted in every micro-batch; a replayed batch replaces its earlier counts.

    One short entry per batch is held; ``drain`` gives the entries away, for a long-running stream to store.
    """

    def __init__(self) -> None:
        self._counts: dict[tuple[str, int], list[tuple]] = {}
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        counted = event.progress.observedMetrics.get(OBSERVED)
        if counted is None:
            return
        run, batch = str(event.progress.id), event.progress.batchId
        with self._lock:
            self._counts[run, batch] = _rows(run, batch, counted.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def drain(self, spark: SparkSession) -> DataFrame:
        """The counts so far, which are then forgotten."""
        with self._lock:
            rows, self._counts = [row for own in self._counts.values() for row in own], {}
        return spark.createDataFrame(rows, LAYOUT)
