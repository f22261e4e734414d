"""Running values over keys of any size: rows ranged over parts, folded per part, and carried from part to part.

A key's rows are put in order by range parts, whose bounds Spark takes from a sample, so a key or a moment that holds
most rows is spread over as many parts as its share asks for. The ranged rows are written once; that fixes the parts
also for tasks that are run again. Each part is folded to one row per key in it, those few rows are summed in order,
and every row then needs its own part only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import fresh_path

_PART = "_part"


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """The rows as a table with ``_part``: parts follow each other in the order of the keys and the order columns.

    Rows that agree in all of them share a part; give an order that tells rows apart, as ties are one group otherwise.
    """
    spark = df.sparkSession
    number = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_path(spark, "ranged")
    df.repartitionByRange(number, *keys, *order).withColumn(_PART, F.spark_partition_id()).write.parquet(path)
    return spark.read.schema(T.StructType([*df.schema.fields, T.StructField(_PART, T.IntegerType())])).parquet(path)


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)])


def _with_carried(rows: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row beside what its key brings from earlier parts; null keys are keys too."""
    own = [*keys, _PART]
    names = {k: f"_of_{k}" for k in own}
    return rows.join(carried.withColumnsRenamed(names), _same(own, list(names.values()))).drop(*names.values())


def running_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, parts: int | None = None) -> DataFrame:
    """Position of each row within its key, from 1."""
    rows = ranged(df, keys, order, parts)
    sizes = rows.groupBy(*keys, _PART).agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, _PART, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, _PART).orderBy(*order)
    placed = _with_carried(rows, starts, keys)
    return placed.withColumn(name, F.col("_start") + F.row_number().over(inside)).drop("_start", _PART)


def as_of(
    df: DataFrame,
    versions: DataFrame,
    keys: Sequence[str],
    time: str,
    valid_from: str,
    value: str,
    tie_break: Sequence[str] = (),
    parts: int | None = None,
) -> DataFrame:
    """Each row with ``value`` of the last version of its key that is valid at its time, null before the first.

    Both sides are merged in the order of key and time, and the last version is carried forward, so no row is made for
    a pair. A version counts from its own moment on; of several of one moment the greatest value counts. ``tie_break``
    names columns of ``df`` that tell rows of one moment apart, so that such a moment can be spread. Rows without a time
    get no version; a null key has the versions of the null key.
    """
    taken = F.struct(F.lit(True).alias("set"), F.col(value).alias("value"))
    own = df.withColumns({"_at": F.col(time), "_side": F.lit(1), "_version": F.lit(None).cast(versions.select(taken).schema[0].dataType)})
    brought = versions.filter(F.col(valid_from).isNotNull()).groupBy(*keys, F.col(valid_from).alias("_at")).agg(F.max(value).alias(value))
    brought = brought.select(*keys, "_at", F.lit(0).alias("_side"), taken.alias("_version"))
    order = ["_at", "_side", *tie_break]
    rows = ranged(own.unionByName(brought, allowMissingColumns=True), keys, order, parts)

    last = F.max(F.when(F.col("_side") == 0, F.struct("_at", "_version"))).alias("_last")
    ends = rows.groupBy(*keys, _PART).agg(last)
    earlier = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    brought_in = ends.select(*keys, _PART, F.last("_last._version", ignorenulls=True).over(earlier).alias("_before"))
    inside = Window.partitionBy(*keys, _PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    carried = F.coalesce(F.last("_version", ignorenulls=True).over(inside), "_before")
    merged = _with_carried(rows, brought_in, keys).withColumn("_now", F.when(F.col("_at").isNotNull(), carried))
    return merged.filter("_side = 1").select(*df.columns, F.col("_now.value").alias(value))
