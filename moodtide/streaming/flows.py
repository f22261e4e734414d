"""Stateful stream operators, and the starting and reading back of streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.hashing import content_key
from ..settings import UPDATE_INTERVAL_SECONDS
from ..sinks.tables import stream_id
from ..sources.conform import union_sources

LATENESS = "1 hour"
BatchWriter = Callable[[DataFrame, int], None]
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
#: The store that holds several states and timers for a key; Spark's default store holds one only.
KEYED_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).parquet(path)


def union_stream(*sources: DataFrame) -> DataFrame:
    """Source streams in the post layout as one stream."""
    return union_sources(*sources)


def dedup_stream(posts: DataFrame, lateness: str = LATENESS, salts: int = 16) -> DataFrame:
    """The first arrival of each ``(platform, id)``; keys are forgotten once past the watermark.

    Rows without an id are told apart by their content, as ``dedup_posts`` does.

    Copies are first dropped within ``salts`` parts of a key, so that of a post that makes up
    much of a batch only a row per part reaches the task of its key. With ``salts=1``, for
    keys known to be even, that first step and its state are left out.
    """
    own = F.when(F.col("id").isNull(), content_key(posts.columns))
    marked, keys = posts.withColumn("_own", own).withWatermark("collected_at", lateness), ["platform", "id", "_own"]
    if salts > 1:
        part = F.pmod(F.spark_partition_id(), F.lit(salts))
        marked = (
            marked.withColumn("_part", part).dropDuplicatesWithinWatermark([*keys, "_part"]).drop("_part")
        )
    return marked.dropDuplicatesWithinWatermark(keys).drop("_own")


def hourly_counts(results: DataFrame, label: Column, time: str = "processed_at", lateness: str = LATENESS) -> DataFrame:
    """Rows per hour and label, kept as state until the hour is past the watermark."""
    return (
        results.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, lateness)
        .groupBy(F.window(time, "1 hour").alias("window"), label.alias("label"))
        .agg(F.count("*").alias("count"))
        .select(F.col("window.start").alias("hour"), "label", "count")
    )


def sliding_summary(hourly: DataFrame, hours: int = 24) -> DataFrame:
    """Rows per label in every span of ``hours`` that starts on the hour, from the hourly counts.

    Folding the hourly table costs ``hours`` short rows per hour and label, where a sliding
    window over the posts would copy each post that often.
    """
    starts = F.explode(F.sequence(F.lit(0), F.lit(hours - 1))).alias("back")
    return (
        hourly.select("*", starts)
        .withColumn("window_start", F.col("hour") - F.make_dt_interval(hours=F.col("back")))
        .groupBy("window_start", "label")
        .agg(F.sum("count").alias("count"))
    )


def batch_path(spark: SparkSession, path: str, batch_id: int) -> str:
    """The folder of one batch of the stream that runs in this thread."""
    return f"{path}/writer={stream_id(spark) or 'direct'}/batch={batch_id}"


def append_batches(path: str) -> BatchWriter:
    """Each micro-batch in a folder of its stream, replaced if the batch is replayed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_path(batch.sparkSession, path, batch_id))

    return write


def latest_changes(spark: SparkSession, path: str, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The last state written for each key by a query in update mode."""
    changes = spark.read.parquet(path)
    last = F.max(F.struct("batch", *values)).alias("last")
    return changes.groupBy(*keys).agg(last).select(*keys, *[F.col(f"last.{v}").alias(v) for v in values])


@contextmanager
def _keyed_store(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in ``KEYED_STORE``; each takes its settings along when it is started."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, KEYED_STORE)
    try:
        yield
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def start(stream: DataFrame, write: BatchWriter, checkpoint: str, mode: str = "append", once: bool = False,
          interval_seconds: int = UPDATE_INTERVAL_SECONDS, keyed_state: bool = False) -> StreamingQuery:
    """Start a query that hands every micro-batch to ``write``, on the interval or until the input is read.

    ``keyed_state`` is for streams with a state processor (``streaming/errors.py``): they need a store that the
    session need not have chosen.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    every = {"availableNow": True} if once else {"processingTime": f"{interval_seconds} seconds"}
    with _keyed_store(stream.sparkSession) if keyed_state else nullcontext():
        return writer.trigger(**every).start()


def run_once(stream: DataFrame, write: BatchWriter, checkpoint: str, mode: str = "append", keyed_state: bool = False) -> None:
    """Read all input there is, then stop; a failure of the query is raised here."""
    start(stream, write, checkpoint, mode, once=True, keyed_state=keyed_state).awaitTermination()
