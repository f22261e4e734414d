"""Polled sources: caps, restarts, replays, broken folders and files."""

import gzip
import os

import pytest

from moodtide.sources import polling
from moodtide.streaming import flows


def land(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    data = "\n".join(lines).encode()
    with open(f"{folder}/{name}", "wb") as out:
        out.write(gzip.compress(data) if name.endswith(".gz") else data)


@pytest.fixture
def folders(tmp_path):
    for i in range(5):
        land(str(tmp_path / "a"), f"{i:03d}.json", [f'{{"n": {i}{k}}}' for k in range(3)])
    land(str(tmp_path / "b"), "000.json.gz", ['{"n": 7}', "", "not json"])
    land(str(tmp_path / "b"), "_unfinished", ["x"])
    return {"a": str(tmp_path / "a"), "b": str(tmp_path / "b"), "gone": str(tmp_path / "gone")}


def poll(spark, tmp_path, folders, caps):
    stream = polling.polled_stream(spark, folders, caps, str(tmp_path / "progress" / "at.json"))
    flows.run_once(stream, flows.append_batches(str(tmp_path / "out")), str(tmp_path / "cp"))
    return spark.read.parquet(str(tmp_path / "out"))


def test_a_poll_takes_the_cap_of_each_source_and_a_broken_one_only_says_so(spark, tmp_path, folders):
    sizes = []
    for _ in range(4):
        got = poll(spark, tmp_path, folders, {"a": 2}).collect()
        sizes.append(len({r.file for r in got if r.source == "a"}))
    assert sizes == [2, 4, 5, 5]
    assert sum(r.source == "a" for r in got) == 15
    assert [(r.line, r.record) for r in got if r.source == "b"] == [(1, '{"n": 7}'), (3, "not json")]
    assert [(r.problem, r.record) for r in got if r.source == "gone"] == [("FileNotFoundError", None)]


def test_a_source_that_comes_back_is_read_from_its_start(spark, tmp_path, folders):
    poll(spark, tmp_path, folders, {})
    land(folders["gone"], "000.json", ["{}"])
    land(folders["a"], "005.json", ["{}"])
    got = poll(spark, tmp_path, folders, {}).collect()
    assert sum(r.source == "gone" and r.record is not None for r in got) == 1
    assert sum(r.source == "a" for r in got) == 16


def test_a_replayed_range_gives_the_same_rows(folders, tmp_path):
    options = {"sources": __import__("json").dumps(folders), "progress": str(tmp_path / "p" / "at.json")}
    reader = polling.PollStreamReader(options)
    start, end = reader.initialOffset(), reader.latestOffset()
    land(folders["a"], "009.json", ["later"])

    def rows(own):
        return [r for part in own.partitions(start, end) for batch in own.read(part) for r in batch.to_pylist()]

    assert rows(reader) == rows(polling.PollStreamReader(options))
    assert not any(r["record"] == "later" for r in rows(reader))
    assert [r for part in reader.partitions(end, end) for batch in reader.read(part) for r in batch.to_pylist()] == []


def test_a_broken_file_leaves_the_others(spark, tmp_path):
    folder = str(tmp_path / "x")
    land(folder, "0.json", ["ok"])
    with open(f"{folder}/1.json.gz", "wb") as out:
        out.write(b"no gzip")
    with open(f"{folder}/2.json", "wb") as out:
        out.write(b"fine\n\xff\xfe\nmore")
    land(folder, "3.json", ["last"])
    got = polling.polled(spark, {"x": folder}).collect()
    assert [r.record for r in got if r.record] == ["ok", "fine", "last"]
    assert sorted((r.file, r.problem) for r in got if r.problem)[1] == ("2.json", "UnicodeDecodeError")


def test_no_sources_and_empty_folders(spark, tmp_path):
    (tmp_path / "e").mkdir()
    assert polling.polled(spark, {}).count() == 0
    assert polling.polled(spark, {"e": str(tmp_path / "e")}).count() == 0
