"""Bringing differing sources into one layout, and setting bad rows aside."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..schemas import BATCH, POST

Normaliser = Callable[[DataFrame], DataFrame]


def conform(df: DataFrame, schema: T.StructType = POST) -> DataFrame:
    """Exactly the schema's columns: extra ones dropped, missing ones null, unreadable values null."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )


def conform_batch(df: DataFrame) -> DataFrame:
    """The narrow nine-column layout; a count beyond 32 bits becomes null, not a failure."""
    return conform(df, BATCH)


def unreadable(df: DataFrame, schema: T.StructType = POST) -> Column:
    """True where a present value would be lost by ``conform``."""
    tests = [
        F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()
        for f in schema.fields
        if f.name in df.columns
    ]
    if "_corrupt_record" in df.columns:
        tests.append(F.col("_corrupt_record").isNotNull())
    return reduce(lambda left, right: left | right, tests, F.lit(False))


def split_quarantine(df: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows and bad rows by one test; a null test counts as bad."""
    flag = F.coalesce(bad, F.lit(True))
    return df.filter(~flag), df.filter(flag)


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows of all sources in the post layout, columns matched by name."""
    return reduce(
        lambda left, right: left.unionByName(right, allowMissingColumns=True),
        [conform(source) for source in sources],
    )


class SourceRegistry:
    """Named normalisers, so a new source is one function added under a name."""

    def __init__(self) -> None:
        self._normalisers: dict[str, Normaliser] = {}

    def add(self, name: str, normaliser: Normaliser) -> None:
        self._normalisers[name] = normaliser

    def collect_all(self, landed: dict[str, DataFrame]) -> DataFrame:
        """Every landed frame through its normaliser, in one union; sources not landed are left out."""
        return union_sources(*[self._normalisers[name](frame) for name, frame in landed.items()])
