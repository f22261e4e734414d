"""Upkeep of stored tables: a closed day folded into few clustered files, and reads that touch only the files they need.

A day collects one folder per platform, writer and batch. Once no batch of it can be replayed any more it is folded:
its rows are ordered along a curve that interleaves the bits of their time, label and key hash, ranged over few files,
and the least and greatest of each of these per file are kept in a small table beside them. A query for a span of
time, a label or a key then opens only the files whose bounds meet it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .tables import LOOKUP_COLUMN, PARTITIONS, Store, _folders, _remove, stored_layout

#: The writer that folded days stand under; its batches are numbered by fold.
FOLDER = "folded"
#: Bits of each of the interleaved values.
BITS = 12
ROWS_PER_FILE = 1_000_000


def _minutes(table: str) -> Column:
    time = F.col("created_at")
    return F.coalesce(F.hour(time) * 60 + F.minute(time), F.lit(0))


def _label(table: str) -> Column:
    return F.col("sentiment.label") if table == "sentiment_results" else F.array_join("keywords", ",")


def _dimensions(table: str) -> dict[str, Column]:
    """The values that a file is bounded in, each with ``BITS`` bits: minute of creation, label or keywords, key."""
    top = 1 << BITS
    return {
        "minute": _minutes(table).cast("long"),
        "label": F.pmod(F.xxhash64(F.coalesce(_label(table), F.lit(""))), F.lit(top)),
        "key": F.pmod(F.xxhash64(F.col(LOOKUP_COLUMN[table])), F.lit(top)),
    }


def curve(values: list[Column], bits: int = BITS) -> Column:
    """One number with the bits of all values in turn, highest first."""
    out = F.lit(0).cast("long")
    for place, value in enumerate(values):
        for bit in range(bits):
            set_ = F.shiftright(value.cast("long"), bit).bitwiseAND(F.lit(1).cast("long"))
            out = out.bitwiseOR(F.shiftleft(set_, bit * len(values) + (len(values) - 1 - place)))
    return out


def _bounds_path(store: Store, table: str, day: str) -> str:
    return f"{store.base}/_bounds_{table}/day={day}"


def fold_day(spark: SparkSession, store: Store, table: str, day: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Put the rows of a closed day into few clustered files; safe to repeat, also after a run that was cut short.

    The folders to be folded are noted first, and the new files are written aside. Only when they are whole are the
    noted folders removed and the new ones put in their place; a run that finds such files goes on from there. Batches
    that arrive meanwhile are not on the note and stay as they are for the next fold.
    """
    aside = f"{store.base}/_folding_{table}/day={day}"
    if not _folders(spark, f"{aside}/note/_SUCCESS"):
        held = _folders(spark, f"{store.path(table)}/day={day}/platform=*/writer=*/batch_id=*")
        if len(held) <= len({folder.split("/platform=")[1].split("/")[0] for folder in held}) and all(f"writer={FOLDER}/" in h for h in held):
            return
        _write_aside(spark, store, table, day, held, aside, rows_per_file)
    _put_in_place(spark, store, table, day, aside)


def _write_aside(spark: SparkSession, store: Store, table: str, day: str, held: list[str], aside: str, rows_per_file: int) -> None:
    _remove(spark, aside)
    rows = spark.read.option("basePath", store.path(table)).schema(stored_layout(table)).parquet(*held)
    values = {**_dimensions(table), "minute": (_minutes(table) * (1 << BITS) / 1440).cast("long")}  # over all bits
    files = max(1, -(-rows.count() // rows_per_file))
    last = max((int(h.rsplit("batch_id=", 1)[1]) for h in held if f"writer={FOLDER}/" in h), default=-1)
    placed = rows.withColumns({"writer": F.lit(FOLDER), "batch_id": F.lit(last + 1), "_curve": curve(list(values.values()))})
    (
        placed.repartitionByRange(files, "platform", "_curve")
        .sortWithinPartitions("platform", "_curve")
        .drop("_curve")
        .write.option(f"parquet.bloom.filter.enabled#{LOOKUP_COLUMN[table]}", "true")
        .partitionBy(*PARTITIONS)
        .parquet(f"{aside}/rows")
    )
    note = spark.createDataFrame([(json.dumps(held),)], "folders string")
    note.coalesce(1).write.json(f"{aside}/note")


def _put_in_place(spark: SparkSession, store: Store, table: str, day: str, aside: str) -> None:
    for folder in json.loads(spark.read.json(f"{aside}/note").first()["folders"]):
        _remove(spark, folder)
    files = spark._jvm.org.apache.hadoop.fs.Path(aside).getFileSystem(spark._jsc.hadoopConfiguration())
    at = spark._jvm.org.apache.hadoop.fs.Path
    for made in _folders(spark, f"{aside}/rows/day={day}/platform=*/writer=*/batch_id=*"):
        target = f"{store.path(table)}/day={day}/" + made.rsplit(f"/day={day}/", 1)[1]
        if not files.exists(at(target)):
            files.mkdirs(at(target).getParent())
            files.rename(at(made), at(target))
    _bounds(spark, store, table, day).write.mode("overwrite").parquet(_bounds_path(store, table, day))
    _remove(spark, aside)


def _bounds(spark: SparkSession, store: Store, table: str, day: str) -> DataFrame:
    """file, rows, and the least and greatest of each dimension, for the files of a folded day."""
    rows = store.read(spark, table).filter((F.col("day") == day) & (F.col("writer") == FOLDER))
    own = rows.select(F.col("_metadata.file_path").alias("file"), *[v.alias(n) for n, v in _dimensions(table).items()])
    edges = [f(n).alias(f"{edge}_{n}") for n in _dimensions(table) for edge, f in (("low", F.min), ("high", F.max))]
    return own.groupBy("file").agg(F.count("*").alias("rows"), *edges)


def files_for(spark: SparkSession, store: Store, table: str, day: str, minutes: tuple[int, int] | None = None,
              label: str | None = None, key: str | None = None) -> list[str]:
    """Files of a folded day that may hold rows of a span of minutes, a label (or keywords, joined by commas) or a key."""
    sought = spark.range(1).select(
        F.pmod(F.xxhash64(F.lit(label if label is not None else "")), F.lit(1 << BITS)).alias("label"),
        F.pmod(F.xxhash64(F.lit(key if key is not None else "")), F.lit(1 << BITS)).alias("key"),
    ).first()
    found = spark.read.parquet(_bounds_path(store, table, day))
    if minutes is not None:
        found = found.filter((F.col("low_minute") <= minutes[1]) & (F.col("high_minute") >= minutes[0]))
    for name, given in (("label", label), ("key", key)):
        if given is not None:
            found = found.filter((F.col(f"low_{name}") <= sought[name]) & (F.col(f"high_{name}") >= sought[name]))
    return [row.file for row in found.select("file").collect()]


def read_folded(spark: SparkSession, store: Store, table: str, day: str, minutes: tuple[int, int] | None = None,
                label: str | None = None, key: str | None = None) -> DataFrame:
    """Rows of a day for a span of minutes, a label or a key: the folded files that may hold them, and what came after the fold."""
    tests = F.lit(True)
    if minutes is not None:
        tests = tests & _minutes(table).between(*minutes)
    if label is not None:
        tests = tests & (_label(table) == label)
    if key is not None:
        tests = tests & (F.col(LOOKUP_COLUMN[table]) == key)
    schema, base = stored_layout(table), store.path(table)
    chosen = files_for(spark, store, table, day, minutes, label, key)
    later = [f for f in _folders(spark, f"{base}/day={day}/platform=*/writer=*/batch_id=*") if f"writer={FOLDER}/" not in f]
    if not chosen and not later:
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", base).schema(schema).parquet(*chosen, *later).filter(tests)
