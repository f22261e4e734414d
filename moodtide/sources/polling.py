"""Polling of landed files as a Spark data source: a cap per source and poll, and sources that fail alone.

Each source is a folder into which responses are landed as files of JSON lines; a file does not change once it is
there, and names rise with time. A poll takes up to ``cap`` files of each source that no poll has taken before. What
was read is an offset (the last file of every source), so a batch that is replayed reads the same files again, and a
source that cannot be listed or read gives a row that says so while the others go on.

The driver lists folders; lines are read by the executors, a part of at most ``PART`` files each, in Arrow batches of
bounded size, through Arrow's file systems (local folders, HDFS, object stores).
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "landed_polls"
LAYOUT = "source string, file string, line long, record string, problem string"
_NAMES = [column.split()[0] for column in LAYOUT.split(", ")]
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
#: Files that one task reads; bytes read, and lines sent on, at once.
PART = 8
CHUNK = 1 << 20
LINES = 4096


@dataclass
class FilesOf(InputPartition):
    """Some files of a source, or the problem that kept it from being listed."""

    source: str
    folder: str
    files: tuple[str, ...]
    problem: str | None = None


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def landed_files(folder: str, after: str = "") -> list[str]:
    """Names of the files in the folder that come after the given one, in order; hidden and unfinished ones are left out."""
    system, path = _opened(folder)
    entries = system.get_file_info(fs.FileSelector(path))
    names = (entry.base_name for entry in entries if entry.type == fs.FileType.File)
    return sorted(name for name in names if name > after and name[0] not in "._")


def _lines(folder: str, name: str) -> Iterator[str]:
    """The lines of a file, split on line feeds; compressed files by their ending."""
    system, path = _opened(folder)
    with system.open_input_stream(f"{path}/{name}") as stream:
        rest = b""
        while chunk := stream.read(CHUNK):
            *whole, rest = (rest + chunk).split(b"\n")
            yield from (line.decode() for line in whole)
        if rest:
            yield rest.decode()


def _batch(rows: Sequence[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)


def read_files(part: FilesOf) -> Iterator[pa.RecordBatch]:
    """The lines of a part's files; a file that fails midway gives the lines before it and a row with the problem."""
    if part.problem is not None:
        yield _batch([(part.source, None, None, None, part.problem)])
    for name in part.files:
        rows, number = [], 0
        try:
            for number, line in enumerate(_lines(part.folder, name), 1):
                if line.strip():
                    rows.append((part.source, name, number, line, None))
                if len(rows) == LINES:
                    yield _batch(rows)
                    rows = []
        except (OSError, UnicodeDecodeError, pa.ArrowException) as problem:
            rows.append((part.source, name, number + 1, None, type(problem).__name__))
        if rows:
            yield _batch(rows)


class _Polls:
    """Which files of which sources a poll reads, from the options of the source."""

    def __init__(self, options: dict):
        self.folders: dict[str, str] = json.loads(options["sources"])
        self.caps = {name: int(cap) for name, cap in json.loads(options.get("caps", "{}")).items()}

    def listed(self, name: str, after: str, cap: int | None) -> tuple[list[str], str | None]:
        try:
            found = landed_files(self.folders[name], after)
        except (OSError, pa.ArrowException) as problem:
            return [], type(problem).__name__
        return found[:cap], None

    def parts(self, name: str, files: Sequence[str], problem: str | None) -> list[FilesOf]:
        cut = [FilesOf(name, self.folders[name], tuple(files[i : i + PART])) for i in range(0, len(files), PART)]
        return cut + ([FilesOf(name, self.folders[name], (), problem)] if problem else [])


class PollReader(DataSourceReader):
    """All landed files, without a cap."""

    def __init__(self, options: dict):
        self.polls = _Polls(options)

    def partitions(self) -> Sequence[InputPartition]:
        found = ((name, *self.polls.listed(name, "", None)) for name in self.polls.folders)
        return [part for name, files, problem in found for part in self.polls.parts(name, files, problem)] or [FilesOf("", "", ())]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return read_files(partition)


class PollStreamReader(DataSourceStreamReader):
    """One poll per micro-batch.

    Spark asks for the next offset without saying where it stands, so the reader notes the end of each poll in the file
    named by the option ``progress`` before it gives it away. After a restart it goes on from there; a poll that was
    noted but not begun is then read together with the next one. Nothing is lost or read twice.
    """

    def __init__(self, options: dict):
        self.polls, self.progress = _Polls(options), options["progress"]

    def initialOffset(self) -> dict:
        return {name: {"file": "", "problem": None} for name in self.polls.folders}

    def latestOffset(self) -> dict:
        at = {**self.initialOffset(), **self._noted()}
        end = {}
        for name in self.polls.folders:
            files, problem = self.polls.listed(name, at[name]["file"], self.polls.caps.get(name))
            end[name] = {"file": files[-1] if files else at[name]["file"], "problem": problem}
        if end != at:
            self._note(end)
        return end

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        """The files after the start up to the end; a problem is told when it begins."""
        parts = []
        for name in self.polls.folders:
            first, last = start.get(name, {"file": "", "problem": None}), end.get(name, {"file": "", "problem": None})
            files = []
            if last["file"] > first["file"]:
                listed, gone = self.polls.listed(name, first["file"], None)
                files = [file for file in listed if file <= last["file"]]
                parts += self.polls.parts(name, (), gone)
            new = last["problem"] if last["problem"] != first["problem"] else None
            parts += self.polls.parts(name, files, new)
        return parts or [FilesOf("", "", ())]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return read_files(partition)

    def _noted(self) -> dict:
        system, path = _opened(self.progress)
        if system.get_file_info(path).type != fs.FileType.File:
            return {}
        with system.open_input_stream(path) as stream:
            return json.loads(stream.read())

    def _note(self, end: dict) -> None:
        """Write aside, then put in place, so that a cut write leaves the old note."""
        system, path = _opened(self.progress)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(f"{path}.next") as stream:
            stream.write(json.dumps(end).encode())
        system.move(f"{path}.next", path)


class LandedPolls(DataSource):
    """``spark.read`` and ``spark.readStream`` over the landed files of several sources.

    Options: ``sources`` (JSON: name to folder), ``caps`` (JSON: name to files per poll), ``progress`` (streams: a file).
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LAYOUT

    def reader(self, schema: StructType) -> DataSourceReader:
        return PollReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PollStreamReader(self.options)


def polled(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """All landed lines of the sources, one row each; ``problem`` is set where a file or folder could not be read."""
    spark.dataSource.register(LandedPolls)
    return spark.read.format(FORMAT).option("sources", json.dumps(folders)).load()


def polled_stream(spark: SparkSession, folders: dict[str, str], caps: dict[str, int], progress: str) -> DataFrame:
    """The landed lines as a stream; a batch is one poll of at most the cap's files of each source."""
    spark.dataSource.register(LandedPolls)
    stream = spark.readStream.format(FORMAT).option("sources", json.dumps(folders)).option("caps", json.dumps(caps))
    return stream.option("progress", progress).load()
