"""Labelled texts with a split column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def load_labelled(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """``text``, ``label`` and ``split``; one split only if named, pruned at the scan."""
    df = spark.read.parquet(path).select("text", "label", "split")
    return df.filter(F.col("split") == split) if split else df


def rename_labels(df: DataFrame) -> DataFrame:
    """The column layout the trainer expects: ``labels`` for ``label`` and no raw text."""
    return df.withColumnRenamed("label", "labels").drop("text")
