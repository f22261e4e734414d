"""The lattice against enumeration of all segmentations, and the query's counts against plain Python."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from moodtide.llm import lattice, pieces

from .rows import HARD, frame

PATH = pieces.default_model()
OWN = lattice.lattice(PATH)


def vocabulary():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    longer = [
        p
        for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
        for p in [model.id_to_piece(i).replace("▁", " ").encode()]
        if len(p) > 1 and b" " not in p[1:]
    ]
    return {**{bytes([b]): b for b in range(256)}, **{p: 256 + i for i, p in enumerate(longer)}}


def ways(word, ids):
    """All segmentations of a word as lists of piece ids."""
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in ids:
            for rest in ways(word[k:], ids):
                yield [ids[word[:k]], *rest]


def test_marginals_and_expected_counts_are_those_of_all_segmentations():
    ids = vocabulary()
    weights = np.log(np.exp(OWN.initial) / np.exp(OWN.initial).sum())
    words = [b" the", b" ouble", b" x", " été".encode(), b" ", b" aaaaaa", b" thlyou"]
    (got,) = OWN.log_weights(words, weights)
    total = np.zeros(OWN.size)
    for word, value in zip(words, got):
        each = [(math.fsum(weights[s]), s) for s in ways(word, ids)]
        whole = math.fsum(math.exp(w) for w, _ in each)
        assert value == pytest.approx(math.log(whole))
        for w, s in each:
            for piece in s:
                total[piece] += 2 * math.exp(w) / whole
    assert OWN.expected(words, np.full(len(words), 2.0), weights) == pytest.approx(total)


def test_scores_of_whole_documents_are_sums_over_all_segmentations(spark):
    """By enumeration: pieces alone with the vocabulary's scores; pieces and known words with what was learnt."""
    ids = vocabulary()
    texts = ["the cat", "The ox", "a b a", "", "cats ox the", "zq", "é the"]
    docs = frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    learners = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in learners for w in t.lower().encode().split())
    given, learnt = lattice.vocabulary_weights(PATH), lattice.trained(lattice.counted(docs), PATH)
    once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
    off = once / (once + 2 * twice)
    spelt, whole = off * len(counts) + 1, sum(counts.values()) + len(learners) + 2
    for r in lattice.scored(docs).collect():
        words = texts[r.doc_id].lower().encode().split()
        spelling = b"".join(b" " + w for w in words)
        assert 10**r.lattice_score == pytest.approx(math.fsum(math.exp(math.fsum(given[s])) for s in ways(spelling, ids)))
        units = [
            [counts[w] - off if w in counts else 0.0, *(spelt * math.exp(math.fsum(learnt[s])) for s in ways(b" " + w, ids))] for w in words
        ]
        each = [math.prod(way) for way in itertools.product(*units)]
        assert 10**r.score == pytest.approx(math.fsum(each) / whole ** len(words) * (len(learners) + 1) / whole)


def test_long_words_are_known_by_their_digests(spark):
    """A long line that stands in every document is frequent like any word, and scores as it does when it travels."""
    line, other = "=" * 5_000, "-" * 64
    docs = frame(spark, [(i, f"{line} {other} word{i} {other}x", "en", "s") for i in range(30)])
    whole = sorted(tuple(r) for r in lattice.scored(docs).collect())
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lattice, "FREQUENT", 1)
        assert sorted(tuple(r) for r in lattice.scored(docs).collect()) == [pytest.approx(r) for r in whole]
    words = spark.createDataFrame([(w,) for w in (b"a", b"a" * 64, b"a" * 65, b"")], "w binary")
    assert all(bytes(r.k) == lattice._key(bytes(r.w)) for r in words.select("w", lattice.key_of(words["w"]).alias("k")).collect())


def test_a_long_word_has_a_finite_weight():
    assert np.isfinite(OWN.log_weights([b" " + b"ab" * 4000, b" q"], OWN.initial)).all()


def test_counts_and_base_score(spark):
    docs = frame(spark, HARD, ("word", "c", "_text"))
    train, ends, rows = Counter(), 0, []
    for doc_id, text, *_ in HARD:
        words = (text or "").encode().lower().split()
        held = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2
        rows.append((doc_id, held, words))
        if not held:
            train.update(words)
            ends += 1
    n, v = sum(train.values()) + ends, len(train) + 1
    want = []
    for doc_id, held, words in rows:
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words) + math.log10((ends + 1) / (n + v + 1))
        want.append((doc_id, held, len(words) + 1, sum(w in train for w in words) + 1, n, base))
    got = lattice.scored(docs).collect()
    assert sorted(((*r[:5], pytest.approx(r[5])) for r in map(tuple, got)), key=lambda r: str(r[:5])) == sorted(want, key=lambda r: str(r[:5]))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lattice.scored(frame(spark, [])).count() == 0


def test_rare_words_travel_to_the_same_scores(spark, monkeypatch):
    docs = frame(spark, [(i, f"common word{i % 3} rare{i} common", "en", "s") for i in range(40)])
    whole = {r.doc_id: tuple(r) for r in lattice.scored(docs).collect()}
    monkeypatch.setattr(lattice, "FREQUENT", 1)
    monkeypatch.setattr(lattice, "HELD_WORDS", 5)
    few = {r.doc_id: tuple(r) for r in lattice.scored(docs.repartition(5)).collect()}
    assert {k: pytest.approx(v) for k, v in few.items()} == whole


def test_probabilities_of_words_sum_to_one_at_most(spark):
    """Spelt words and known words share one mass: a sample of strings stays below it, and a known word beats its spelling."""
    docs = frame(spark, [(i, "alpha beta alpha gamma" if i % 2 else "alpha delta", "en", "s") for i in range(60)])
    got = {r.doc_id: r for r in lattice.scored(docs).collect()}
    assert got[1].score > got[1].base_score * 3
    assert max(r.score for r in got.values()) < 0
