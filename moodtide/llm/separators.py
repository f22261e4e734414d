"""Token counts: separators are searched in flat token files without an index, boundaries stitched by a prefix scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import fresh_path
from .common import plain_text, slices
from .pieces import default_model, task_coder

#: The separator: the model's end-of-text id, which no text is encoded to. Ids are two bytes, least first.
SEPARATOR = 2
BLOCK_TOKENS = 1 << 20
#: Largest token file that is read, since a task holds a whole one; characters per written block, and blocks per written file.
FILE_BYTES = 1 << 30
WRITE_CHARS = 1 << 18
FILE_BLOCKS = 64
#: Names of the writer's files: the task's number, the job's UUID, the counter of the task's files.
PART_NAME = r"/part-(\d+)-[^/]*[.-]c(\d+)(?:\.[^/]*)?$"


def write_tokens(docs: DataFrame, path: str, model: str | None = None, separator: int = SEPARATOR) -> None:
    """Write the token ids of all documents as flat files below ``path/kind=tokens``, each document ended by the separator.

    A file holds nothing but ids. What stands in it, in order, is listed in the file of the same number below
    ``path/kind=ids`` (document ids in decimal, "null" for none). Both come from one job, so a repeated task
    writes both again, in the same order. Needs a vocabulary below 65,536; a null text has no tokens.
    """
    model = model or default_model()
    mark = np.array([separator], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_coder(model) as own:
            number = 0
            for batch in batches:
                sizes = pc.utf8_length(batch["_text"]).to_pylist()
                for low, high in slices(sizes, sizes, WRITE_CHARS):
                    part = batch.slice(low, high - low)  # only a block's texts are Python objects at once
                    flat = [ids.astype("<u2").tobytes() for ids in own.encode(part["_text"].to_pylist())]
                    ids = ",".join("null" if i is None else i for i in part["doc_id"].to_pylist())
                    payload = pa.array([mark.join(flat), ids.encode()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(["tokens", "ids"]), pa.array([number, number], pa.int64()), payload], ["kind", "number", "payload"])
                    number += 1

    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), plain_text().alias("_text"))
    blocks = texts.mapInArrow(run, "kind string, number long, payload binary")
    # a row of blocks is written as its bytes, and the writer's line end is the separator after its last document
    rows = blocks.sortWithinPartitions("kind", "number").select("kind", F.col("payload").cast("string").alias("value"))
    rows.write.partitionBy("kind").option("lineSep", mark.decode()).option("maxRecordsPerFile", FILE_BLOCKS).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The files below a path with the number in their name, in which tokens and ids agree.

    Both parts of the number are read from the end of the file's own name: folder names and the job's UUID may hold "-c7" too.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    number = lambda k: F.regexp_extract("path", PART_NAME, k).cast("long")  # noqa: E731  (the task's number and its files' counter)
    return found.select((number(1) * 1_000_000 + number(2)).alias("file"), F.col("length").alias("bytes"), "content")


def segments(files: DataFrame, separator: int = SEPARATOR, block: int = BLOCK_TOKENS) -> DataFrame:
    """file, block, place, n, ends: the runs of tokens between separators or block ends, found block by block.

    ``place`` counts the runs of a block from 0; a run with ``ends`` false goes on in the next block. ``n`` leaves
    the separator out. A block with no tokens after its last separator has no open run.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"]):
                ids = np.frombuffer(content, "<u2")
                for number, low in enumerate(range(0, ids.size, block)):
                    part = ids[low:low + block]
                    at = np.flatnonzero(part == separator)
                    n = np.diff(np.concatenate([[-1], at])) - 1
                    ends = np.ones(n.size, bool)
                    tail = part.size - (at[-1] + 1 if at.size else 0)
                    if tail:
                        n, ends = np.append(n, tail), np.append(ends, False)
                    yield pd.DataFrame({"file": file, "block": number, "place": np.arange(n.size), "n": n, "ends": ends})

    checked = files.withColumn("content", F.when(F.col("bytes") <= FILE_BYTES, F.col("content")).otherwise(
        F.raise_error(F.lit("token file too large: write more, smaller files"))))
    return checked.select("file", "content").mapInPandas(run, "file long, block long, place long, n long, ends boolean")


def counts(runs: DataFrame) -> DataFrame:
    """file, ordinal, n_tokens: the documents of each file in order, with their number of tokens.

    Documents before a block are the separators of all blocks before it in the file: a prefix scan over one row
    per block. The runs of a document that reaches over blocks are then added up. Tokens after a file's last
    separator are a document of their own.
    """
    per_block = runs.groupBy("file", "block").agg(F.sum(F.col("ends").cast("long")).alias("found"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_block.select("file", "block", F.coalesce(F.sum("found").over(before), F.lit(0)).alias("before"))
    return (
        runs.join(offsets, ["file", "block"])
        .groupBy("file", (F.col("before") + F.col("place")).alias("ordinal"))
        .agg(F.sum("n").alias("n_tokens"))
    )


def listed_ids(spark: SparkSession, path: str, separator: int = SEPARATOR) -> DataFrame:
    """file, ordinal, doc_id (as text) of the lists beside the token files."""
    mark = np.array([separator], "<u2").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"]):
                ids = [i or "null" for part in bytes(content).split(mark)[:-1] for i in part.decode().split(",")]
                yield pd.DataFrame({"file": file, "ordinal": np.arange(len(ids)), "doc_id": [None if i == "null" else i for i in ids]})

    return _files(spark, f"{path}/kind=ids").select("file", "content").mapInPandas(run, "file long, ordinal long, doc_id string")


def token_counts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every row, read back from flat token files written for it in the shared folder.

    Repeated rows give repeated rows, null texts 0 tokens; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "token-files")
    write_tokens(docs, path, model)
    kind = dict(docs.dtypes)["doc_id"]
    if docs.isEmpty():
        return docs.select("doc_id", F.lit(0).cast("long").alias("n_tokens"))
    found = counts(segments(_files(spark, f"{path}/kind=tokens")))
    return found.join(listed_ids(spark, path), ["file", "ordinal"]).select(F.col("doc_id").cast(kind).alias("doc_id"), "n_tokens")
