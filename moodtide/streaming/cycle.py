"""One collection cycle as a micro-batch: quarantine, store, clean, score, store, summarise."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.cleaning import clean_posts, dedup_posts, text_fallback
from ..operators.scoring import Scorer, score_posts
from ..operators.summary import batch_stats
from ..session import fresh_path
from ..sinks.tables import Store, insert_raw_posts, insert_results, _remove
from ..sources.conform import split_quarantine, unreadable
from ..sources.keywords import match_keyword_table
from .flows import BatchWriter, batch_path


@dataclass(frozen=True)
class Cycle:
    """What a micro-batch needs to know; call it from ``foreachBatch``.

    Every table is written before it is read for the next step, so no step recomputes an
    earlier one, nothing is held in executor memory between them (the incoming rows and
    those to be scored stand on disk until they are written), and a replayed batch
    replaces what its own writer wrote (see ``Store``). ``as_of`` fixes the processing time for repeatable runs.
    """

    store: Store
    scorer: Scorer
    as_of: str | None = None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = f"writer={self.store.writer_in(spark)}/batch={batch_id}"
        batch.persist(StorageLevel.DISK_ONLY)  # read from its source once for both writes
        try:
            good, bad = split_quarantine(batch, self._bad(batch))
            bad.write.mode("overwrite").parquet(f"{self.store.path('quarantine')}/{own}")
            insert_raw_posts(good, self.store, batch_id)
        finally:
            batch.unpersist()

        raw = self.store.read_batch(spark, "raw_posts", batch_id)
        kept, path = dedup_posts(clean_posts(text_fallback(raw))), fresh_path(spark, "kept")
        try:
            kept.write.parquet(path)  # a scorer may read its posts several times
            posts = spark.read.schema(kept.schema).parquet(path)
            insert_results(score_posts(posts, self.scorer, self.as_of), self.store, batch_id, self.as_of)
        finally:
            _remove(spark, path)

        results = self.store.read_batch(spark, "sentiment_results", batch_id)
        batch_stats(results).write.mode("overwrite").json(f"{self.store.path('cycle_stats')}/{own}")

    @staticmethod
    def _bad(batch: DataFrame) -> Column:
        return unreadable(batch) | F.col("id").isNull() | F.col("platform").isNull() | F.col("collected_at").isNull()


def keyword_writer(keywords_path: str, path: str) -> BatchWriter:
    """Writes keyword matches of each micro-batch against the keyword table as it is at that time."""

    def write(batch: DataFrame, batch_id: int) -> None:
        keywords = batch.sparkSession.read.parquet(keywords_path)
        matches = match_keyword_table(batch, keywords)
        matches.write.mode("overwrite").parquet(batch_path(batch.sparkSession, path, batch_id))

    return write
