"""Joins and top-k that hold when one side is larger, or one key hotter, than hoped."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import settings


#: Parts that rows with a null key are spread over.
NULL_PARTS = 4096
#: Rows of a hot key in the sample that looks for such keys.
SAMPLED = 10_000


def small_table(spark: SparkSession, rows: Sequence[tuple], columns: Sequence[str]) -> DataFrame:
    """Literal rows as a local relation, whose exact size the optimizer knows."""
    data = {name: [row[i] for row in rows] for i, name in enumerate(columns)}
    return spark.createDataFrame(pa.table(data))


def is_small(lookup: DataFrame) -> bool:
    """Whether a lookup is measured to be within the bounds for sending it to every executor.

    The measurement reads at most one row more than the row bound.
    """
    measured = (
        lookup.limit(settings.LOOKUP_ROW_BOUND + 1)
        .agg(F.count("*").alias("n"), F.sum(F.length(F.to_json(F.struct("*")))).alias("chars"))
        .first()
    )
    return measured.n <= settings.LOOKUP_ROW_BOUND and (measured.chars or 0) * 4 <= settings.LOOKUP_BYTE_BOUND


def lookup_join(df: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join to a lookup by broadcast if it is small, else by shuffle with hot keys spread."""
    if is_small(lookup):
        return df.join(F.broadcast(lookup), list(keys), how)
    return salted_lookup(df, lookup, keys, how)


def salted_lookup(
    df: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    spread_on: Sequence[str] | None = None,
    sizes: DataFrame | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Join to a lookup with few rows per key, spreading keys that hold very many rows.

    A key with more than ``hot_rows`` rows is split by ``spread_on`` (all other columns if not given) into
    as many parts as it has times that number, and only its lookup row is repeated for them. There can be no
    more than ``rows / hot_rows`` such keys (a million in 10^12 rows), which bounds the broadcast. Rows with a
    null key match nothing and are spread by their other columns.
    ``sizes`` gives keys and their ``count`` where the caller has them already; otherwise keys are counted in a
    sample in which such a key has about ``SAMPLED`` rows. The sample only chooses how keys are spread, never which
    rows come out.
    """
    above = settings.HOT_KEY_ROWS if hot_rows is None else hot_rows
    share = min(1.0, SAMPLED / max(above, 1)) if sizes is None else 1.0
    seen = df if share == 1.0 else df.sample(share, seed=7)
    counted = seen.groupBy(*keys).count() if sizes is None else sizes
    parts = F.ceil(F.col("count") / share / above).cast("int").alias("_parts")
    hot = F.broadcast(counted.filter(F.col("count") > above * share).select(*keys, parts))
    others = [c for c in df.columns if c not in keys] if spread_on is None else spread_on
    lost = reduce(or_, [F.col(k).isNull() for k in keys])
    of = F.when(lost, F.lit(NULL_PARTS)).otherwise(F.coalesce("_parts", F.lit(1)))
    left = df.join(hot, list(keys), "left").withColumn("_salt", spread(others, of).cast("int")).drop("_parts")
    copies = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    right = lookup.join(hot, list(keys), "left").withColumn("_salt", F.explode(copies)).drop("_parts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def widened(df: DataFrame) -> DataFrame:
    """The frame spread over all cores if its scan has fewer parts than that, else as it is.

    For costly work on the rows of a few small files. A large table has far more parts than
    there are cores and is never moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def each(df: DataFrame, values: Column, *kept: str | Column, name: str) -> DataFrame:
    """One row per array entry beside the kept columns.

    The array is made in a projection of its own, where parts it repeats are computed once.
    A plain explode would make the optimizer add a filter on the array's size and compute the
    array again for it; exploding with a null row for an empty array, and dropping that row,
    does not.
    """
    made = df.select(*kept, values.alias("_each"))
    rest = [c for c in made.columns if c != "_each"]
    return made.select(*rest, F.explode_outer("_each").alias(name)).filter(F.col(name).isNotNull())


def spread(columns: Sequence[str], parts: int | Column) -> Column:
    """A number below ``parts`` that a repeated task gives again, differing even between equal copies.

    It mixes the columns with the number of the input partition, never with the row order.
    """
    return F.pmod(F.xxhash64(*columns, F.spark_partition_id()), F.lit(parts) if isinstance(parts, int) else parts)
