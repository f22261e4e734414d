"""Counts from flat token files against the coder."""

import numpy as np
import pytest

from moodtide.llm import pieces, separators

from .rows import HARD, frame

CODER = pieces.coder(pieces.default_model())


def test_counts_of_hard_rows(spark):
    got = sorted((tuple(r) for r in separators.token_counts(frame(spark, HARD, ("kind", "file")).repartition(3)).collect()), key=str)
    assert got == sorted(((i, CODER.encode([t or ""])[0].size) for i, t, *_ in HARD), key=str)
    assert separators.token_counts(frame(spark, [])).count() == 0


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_boundaries_are_stitched_across_blocks(spark, block):
    rng = np.random.default_rng(block)
    files = []
    for number in range(3):
        ids = np.where(rng.random(200) < 0.2, 2, rng.integers(3, 60_000, 200)).astype("<u2")
        files.append((number, ids.size * 2, bytearray(ids.tobytes()), ids))
    frame_ = spark.createDataFrame([f[:3] for f in files], "file long, bytes long, content binary")
    got = {(r.file, r.ordinal): r.n_tokens for r in separators.counts(separators.segments(frame_, block=block)).collect()}
    want = {}
    for number, _, _, ids in files:
        runs = np.split(ids, np.flatnonzero(ids == 2) + 1)
        for k, run in enumerate(runs):
            if run.size:
                want[number, k] = int((run != 2).sum())
    assert got == want


def test_files_hold_nothing_but_ids(spark, tmp_path):
    docs = frame(spark, HARD).coalesce(1)
    separators.write_tokens(docs, str(tmp_path / "t"))
    (file,) = (tmp_path / "t" / "kind=tokens").glob("part-*")
    ids = np.frombuffer(file.read_bytes(), "<u2")
    want = np.concatenate([np.append(CODER.encode([t or ""])[0], 2) for _, t, *_ in HARD])
    assert (ids == want).all()


@pytest.mark.parametrize("folder", ["token-files-c7", "part-3-c7.c5"])
def test_files_of_one_task_stay_apart_under_any_folder_name(spark, tmp_path, monkeypatch, folder):
    """One block a file, several files a task, and a counter's look-alike in the path."""
    monkeypatch.setattr(separators, "FILE_BLOCKS", 1)
    monkeypatch.setattr(separators, "WRITE_CHARS", 60)
    monkeypatch.setattr(separators, "fresh_path", lambda *_: str(tmp_path / folder))
    rows = [(i, "some words " * (1 + i % 7), "en", "s") for i in range(40)]
    got = sorted(tuple(r) for r in separators.token_counts(frame(spark, rows).coalesce(1)).collect())
    assert got == [(i, CODER.encode([t])[0].size) for i, t, *_ in rows]
    files = separators._files(spark, str(tmp_path / folder / "kind=tokens"))
    assert files.count() == files.select("file").distinct().count() > 5


def test_a_file_above_the_bound_is_refused(spark, monkeypatch):
    monkeypatch.setattr(separators, "FILE_BYTES", 3)
    files = spark.createDataFrame([(0, 4, bytearray(b"abcd"))], "file long, bytes long, content binary")
    with pytest.raises(Exception, match="too large"):
        separators.segments(files).collect()


def test_workers_remember_nothing_after_a_task(spark, tmp_path):
    """Workers outlive tasks: what one keeps stays in its executor's memory beside all that runs later."""
    rows = [(i, " ".join(f"word{i * 100 + k}" for k in range(100)), "en", "s") for i in range(40)]
    docs = frame(spark, rows).repartition(4)
    separators.write_tokens(docs, str(tmp_path / "t"))
    assert pieces.digests(docs).agg({"n_tokens": "sum"}).first()[0] > 0

    def held(batches):
        for batch in batches:
            known = pieces.coder.cache_info().currsize
            yield batch.assign(id=len(pieces.coder(pieces.default_model()).index) if known else -1)

    kept = [r.id for r in spark.range(0, 64, 1, 8).mapInPandas(held, "id long").collect()]
    assert max(kept) == 0
