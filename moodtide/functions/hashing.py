"""Hashes that give the same value on every engine and partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def stable_hash(value: Column) -> Column:
    """First 32 bits of the MD5 of the value's text, as a long."""
    return F.conv(F.substring(F.md5(value.cast("string")), 1, 8), 16, 10).cast("long")


def in_test_split(key: Column, percent: int = 20) -> Column:
    """True for about ``percent`` of the keys, always the same ones."""
    return stable_hash(key) % 100 < percent


def content_key(columns: Sequence[str]) -> Column:
    """A 256-bit hash of the columns' values, nulls told apart from empty texts."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
