"""Removal of repeated substrings against a direct search, on hard rows and in small blocks."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from moodtide.llm import substrings

from .rows import HARD, LONG, frame

SCHEMA = "doc_id long, text string"


def direct(rows, length):
    """All documents in order; a place is a repeat if its string was met before."""
    docs = [(i, (text or "").encode()) for i, text in rows]
    order = sorted(range(len(docs)), key=lambda n: (docs[n][0] is None, docs[n][0] or 0, hashlib.sha256(docs[n][1]).digest()))
    seen, out = set(), []
    for n in order:
        doc_id, body = docs[n]
        gone = bytearray(len(body))
        for at in range(len(body) - length + 1):
            piece = body[at : at + length]
            if piece in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(piece)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        out.append((doc_id, len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(docs, length):
    return sorted((tuple(r) for r in substrings.digest(substrings.removed(docs, length)).collect()), key=str)


@pytest.mark.parametrize("period", substrings.COVERS)
def test_covers_hold_every_difference_once(period):
    cover = substrings.COVERS[period]
    assert sorted((a - b) % period for a in cover for b in cover if a != b) == list(range(1, period))


def passages(seed, n):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdé \n") for _ in range(rng.randint(5, 160))) for _ in range(12)]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(pool) if rng.random() < 0.7 else "".join(rng.choice("xyz") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 9)))
        rows.append((rng.choice([i, i, i, 3, None]), text))
    return rows + rows[:4]


@pytest.mark.parametrize(("length", "block"), [(100, 1 << 20), (100, 700), (20, 300), (40, 1500)])
def test_as_a_direct_search(spark, monkeypatch, length, block):
    monkeypatch.setattr(substrings, "BLOCK", block)
    monkeypatch.setattr(substrings, "BUCKET", 5000)
    rows = passages(length + block, 40)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3), length) == direct(rows, length)


@pytest.mark.parametrize("clash", [(), ("block", "place", "body", "text_key", "bucket", "data")])
def test_hard_rows(spark, clash):
    rows = [(i, text) for i, text, *_ in HARD if text != LONG]
    docs = frame(spark, HARD, clash).filter(F.coalesce(F.col("text"), F.lit("")) != LONG)
    assert got(docs, 20) == direct(rows, 20)


def test_a_long_text_that_repeats_itself_keeps_its_period(spark):
    tile = "alpha beta gamma delta "
    (row,) = got(frame(spark, [(6, LONG, "en", "b")]), 100)
    assert row[1:4] == (len(LONG), len(LONG) - len(tile), 1)
    assert row[4] == hashlib.sha256(tile.encode()).hexdigest()


def test_empty_table_and_short_texts(spark):
    assert got(frame(spark, []), 100) == []
    rows = [(1, "x" * 99), (2, "x" * 99), (3, None), (4, "")]
    assert all(r[2] == 0 for r in got(spark.createDataFrame(rows, SCHEMA), 100))


def test_spans_and_kept_bytes(spark):
    shared = "".join(chr(97 + i % 26) for i in range(97)) + "END"
    rows = [(1, "one " + shared + " rest"), (2, "two:" + shared + "!")]
    out = {r.doc_id: r for r in substrings.removed(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [tuple(s) for s in out[2].spans] == [(4, 104)]
    assert (bytes(out[2].kept), out[1].spans) == (b"two:!", [])


def test_keys_are_sent_by_bucket_then_document_then_place():
    import numpy as np

    draw = np.random.default_rng(3)
    texts = substrings.Texts.__new__(substrings.Texts)
    texts.ends = np.cumsum([0, 5, 1, 30, 64])
    head, first = np.sort(draw.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2)), draw.integers(0, 100, 500)
    for buckets in (1, 7, 2000):
        order, bucket, owner = texts.sent_order(head, first, buckets)
        every, of = substrings.bucket_of(head, 64, buckets), np.searchsorted(texts.ends, first, "right") - 1
        want = np.lexsort((of, every))
        assert (order == want).all() and (bucket == every[want]).all() and (owner == of[want]).all()
    assert substrings.distinct(np.array([5, 1, 5, 2], np.uint64)).tolist() == [1, 2, 5]
    assert substrings.distinct(np.empty(0, np.uint64)).size == 0 and texts.sent_order(head[:0], first[:0], 3)[0].size == 0
