"""The piece coder against the library itself."""

from hashlib import sha256

import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from moodtide.llm import pieces

from .rows import HARD, frame

MODEL = pieces.default_model()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
CODER = pieces.coder(MODEL)
PARTS = ["a", "ab", "the", " ", "  ", "▁", "\n", "\t", "é", "日本", "😀", "\x00", "<0x41>", "<s>", "=", "----", "ing", "er", " the", "�", "00"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=4)), max_size=20).map("".join))
def test_encodes_and_decodes_as_the_library(text):
    ids = CODER.encode([text])[0]
    assert list(ids) == LIBRARY.encode(text)
    assert CODER.decode(ids) == LIBRARY.decode(LIBRARY.encode(text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(3, 258), st.integers(259, 31_999)), max_size=10))
def test_decodes_any_ids_as_the_library(ids):
    assert CODER.decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("text", ["a" * 3000, " " * 300, "ab" * 2000, "=" * 1500, "x" * 10 + " " * 50 + "y", "abcabcab" * 500])
def test_long_runs(text):
    assert list(CODER.encode([text])[0]) == LIBRARY.encode(text)


def test_texts_above_the_slice_and_a_full_pool(monkeypatch):
    monkeypatch.setattr(pieces, "SLICE", 50)
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    texts = ["some words  with   spaces\nand lines " * 9, "", "short", "one" * 60 + " two"]
    assert [list(i) for i in pieces.PieceCoder(MODEL).encode(texts)] == LIBRARY.encode(texts)


def test_digests_of_every_row(spark):
    got = sorted(map(tuple, pieces.digests(frame(spark, HARD, ("_text", "ids", "n"))).collect()), key=str)
    want = []
    for doc_id, text, *_ in HARD:
        ids = LIBRARY.encode(text or "")
        want.append((doc_id, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_round_trip_on_columns_and_empty_table(spark):
    docs = frame(spark, [(i, t, "en", "s") for i, t in enumerate(["plain words", "two  spaces", ""])])
    back = pieces.detokenised(pieces.tokenised(docs)).orderBy("doc_id").collect()
    assert [r.decoded for r in back] == ["plain words", "two  spaces", ""]
    assert pieces.digests(frame(spark, [])).count() == 0


def test_a_task_that_sends_ids_on_remembers_less(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 40)
    own = pieces.PieceCoder(MODEL)
    own.remembered = pieces.REMEMBERED // 4
    texts = [f"word{i} other{i} third{i}" for i in range(30)]
    for text in texts:
        assert [list(i) for i in own.encode([text])] == LIBRARY.encode([text])
        assert len(own.index) <= 10 + 3
