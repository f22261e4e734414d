"""What the operators of this package share: inputs, written tables, column names, keyed fractions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import fresh_path

#: Fixed by the contract: the white space between words (ASCII blanks only).
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder, read again: lost executors never recompute what came before."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plain_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array."""
    return F.array_remove(F.split(text, WORD_GAP), "")


def id_remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id written as text, modulo a number; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(-1)).cast("int")


def fraction(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone: reruns and repeated tasks give it again."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def slices(values: list, sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive values whose sizes sum to about ``most`` (one value at least)."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(values):
        yield start, len(values)
