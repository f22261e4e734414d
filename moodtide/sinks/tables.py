"""The raw-post and result tables: appends, replay-safe batches, layout, retention, export.

Both tables are Parquet partitioned by day, platform and batch. Rows are rebalanced before
a write, so a platform that holds most rows is split over files instead of one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import timing
from ..schemas import POST, RESULT
from ..settings import RETENTION_DAYS
from ..sources.conform import conform

PARTITIONS = ("day", "platform", "writer", "batch_id")
PARTITION_FIELDS = (T.StructField("day", T.StringType()), T.StructField("writer", T.StringType()), T.StructField("batch_id", T.IntegerType()))
#: Most rows that ``envelope`` takes into its one row.
ENVELOPE_ROWS = 10_000
TIME_COLUMN = {"raw_posts": "collected_at", "sentiment_results": "processed_at"}
LAYOUT = {"raw_posts": POST, "sentiment_results": RESULT}
LOOKUP_COLUMN = {"raw_posts": "id", "sentiment_results": "post_id"}


def stored_layout(table: str) -> T.StructType:
    """The table's columns with those of its partitions; a day stays text."""
    return T.StructType([*LAYOUT[table].fields, *PARTITION_FIELDS])


@dataclass(frozen=True)
class Store:
    """A folder with the raw-post and result tables in it.

    A batch is known by its writer and its number: batches of other writers are never touched. The writer is the
    given name, else the id that a stream's checkpoint holds (a reset checkpoint is a new writer), else "direct".
    """

    base: str
    writer: str | None = None

    def writer_in(self, spark: SparkSession) -> str:
        return self.writer or stream_id(spark) or "direct"

    def path(self, table: str) -> str:
        return f"{self.base}/{table}"

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.schema(stored_layout(table)).parquet(self.path(table))

    def read_batch(self, spark: SparkSession, table: str, batch_id: int) -> DataFrame:
        """Only the files of this writer's batch, without listing the rest of the table; empty if it has none."""
        schema = stored_layout(table)
        found = spark.read.option("basePath", self.path(table)).schema(schema)
        try:
            return found.parquet(f"{self.path(table)}/day=*/platform=*/writer={self.writer_in(spark)}/batch_id={batch_id}")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)


def stream_id(spark: SparkSession) -> str | None:
    """The id of the stream whose micro-batch runs in this thread; its checkpoint keeps it over restarts."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId")


def write_batch(df: DataFrame, store: Store, table: str, batch_id: int) -> None:
    """Write one batch in the table's layout; the same writer's same batch, written again, is replaced.

    What an earlier attempt wrote is removed by its writer and batch number, since a stamp taken anew
    may put rows under another day.

    Rows are sorted by time inside files so that their minimum and maximum narrow a scan,
    and the key column has a bloom filter for point lookups.
    """
    time, spark = TIME_COLUMN[table], df.sparkSession
    writer = store.writer_in(spark)
    for folder in _folders(spark, f"{store.path(table)}/day=*/platform=*/writer={writer}/batch_id={batch_id}"):
        _remove(spark, folder)
    own = {"day": timing.day_text(F.col(time)), "writer": F.lit(writer), "batch_id": F.lit(batch_id)}
    placed = conform(df, LAYOUT[table]).withColumns(own)
    (
        placed.hint("rebalance", *[F.col(c) for c in PARTITIONS])
        .sortWithinPartitions(*PARTITIONS, "created_at")
        .write.mode("append")
        .option(f"parquet.bloom.filter.enabled#{LOOKUP_COLUMN[table]}", "true")
        .partitionBy(*PARTITIONS)
        .parquet(store.path(table))
    )


def _folders(spark: SparkSession, pattern: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [entry.getPath().toString() for entry in found or []]


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def insert_raw_posts(posts: DataFrame, store: Store, batch_id: int) -> None:
    write_batch(posts, store, "raw_posts", batch_id)


def insert_results(results: DataFrame, store: Store, batch_id: int, as_of: str | None = None) -> None:
    """Results stamped with one processing time at the write."""
    stamp = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    write_batch(results.withColumn("processed_at", stamp), store, "sentiment_results", batch_id)


def retention_keep(df: DataFrame, column: str, as_of: str, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows not older than the retention period; rows without a time stay."""
    return df.filter(~F.coalesce(timing.older_than(df, column, as_of, days=days), F.lit(False)))


def retention_deleted_counts(raw: DataFrame, results: DataFrame, as_of: str, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows of each table that the retention period removes."""

    def counted(df: DataFrame, table: str) -> DataFrame:
        old = timing.older_than(df, TIME_COLUMN[table], as_of, days=days)
        return df.agg(F.count_if(old).alias("deleted")).select(F.lit(table).alias("table_name"), "deleted")

    return counted(raw, "raw_posts").unionByName(counted(results, "sentiment_results"))


def enforce_retention(spark: SparkSession, store: Store, table: str, as_of: str, days: int = RETENTION_DAYS) -> None:
    """Drop whole expired days and rewrite only the day the cutoff falls in.

    The kept part of that day is written aside before the day is replaced. A run that was cut
    short leaves it there, and the next run puts it in place first.
    """
    aside = f"{store.base}/_kept_{table}"
    for folder in _folders(spark, f"{aside}/day=*/_SUCCESS"):
        _replace_day(spark, store, table, folder.removesuffix("/_SUCCESS"))
    cutoff = spark.range(1).select(
        timing.day_text(F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))).alias("day")
    ).first()["day"]
    held = {folder.rsplit("day=", 1)[1]: folder for folder in _folders(spark, f"{store.path(table)}/day=*")}
    for day, folder in held.items():
        if day < cutoff:
            _remove(spark, folder)
    if cutoff in held:
        edge = store.read(spark, table).filter(F.col("day") == cutoff)
        kept = retention_keep(edge, TIME_COLUMN[table], as_of, days)
        kept.write.mode("overwrite").parquet(f"{aside}/day={cutoff}")
        _replace_day(spark, store, table, f"{aside}/day={cutoff}")


def _replace_day(spark: SparkSession, store: Store, table: str, kept: str) -> None:
    day = kept.rsplit("day=", 1)[1]
    _remove(spark, f"{store.path(table)}/day={day}")
    rows = spark.read.schema(stored_layout(table)).parquet(kept)
    rows.write.mode("append").partitionBy(*PARTITIONS).parquet(store.path(table))
    _remove(spark, kept)


def export_results(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Bulk export for reports as ``csv``, ``json`` or ``parquet``."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer = writer.option("header", "true").option("escape", '"')
    writer.format(kind).save(path)


def envelope(rows: DataFrame, as_of: str, with_count: bool = False) -> DataFrame:
    """A small result as one JSON text with success mark, data, time and, if asked, row count.

    For summaries and limited lists only: the data ends up in one row. More than ``ENVELOPE_ROWS`` rows are an error.
    """
    rows = rows.limit(ENVELOPE_ROWS + 1)
    fits = F.when(F.count("*") <= ENVELOPE_ROWS, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"more than {ENVELOPE_ROWS} rows for one envelope")).cast("boolean")
    )
    parts = [
        fits.alias("success"),
        F.sort_array(F.collect_list(F.struct(*rows.columns))).alias("data"),
        F.lit(as_of).alias("timestamp"),
    ]
    if with_count:
        parts.append(F.count("*").alias("count"))
    folded = rows.agg(*parts)
    return folded.select(F.to_json(F.struct(*folded.columns)).alias("json"))
