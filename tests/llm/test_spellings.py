"""Spelling variants against a search over all pairs, in one cell and in many."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from moodtide.llm import spellings

from .rows import HARD, LONG, frame

SCHEMA = "doc_id long, text string"


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def by_all_pairs(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    forms, near = {}, {}
    for w in words:
        others = [o for o in words if one_apart(w, o)]
        near[w] = len(others)
        best = min(others, key=lambda o: (-words[o], o), default=None)
        forms[w] = best if best and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, words[w], near[w], words.get(forms[w])))
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeè÷") for _ in range(rng.randint(5, 8))) for _ in range(25)]
    pool = list(stems)
    for _ in range(250):
        word = rng.choice(pool)
        at = rng.randrange(len(word))
        pool.append(rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice("abcÿ") + word[at:], word[:at] + "d" + word[at + 1 :]]))
    rows = []
    for i in range(60):
        picked = [rng.choice(pool[: rng.choice([4, 30, len(pool)])]) for _ in range(400)]
        rows.append((rng.choice([i, i, None]), rng.choice([" ", ",", "1"]).join(w.upper() if rng.random() < 0.1 and "è" not in w and "ÿ" not in w else w for w in picked)))
    return rows + rows[:2]


@pytest.mark.parametrize(("cell", "leaf", "sample"), [(50_000, 24, 100_000), (12, 4, 100_000), (12, 4, 40)])
def test_as_by_all_pairs(spark, monkeypatch, cell, leaf, sample):
    monkeypatch.setattr(spellings, "CELL", cell)
    monkeypatch.setattr(spellings, "LEAF", leaf)
    monkeypatch.setattr(spellings, "SAMPLE", sample)
    rows = made(cell + sample)
    want = by_all_pairs(rows)
    assert sum(r[4] for r in want) > 100
    assert sorted(map(tuple, spellings.grouped(spark.createDataFrame(rows, SCHEMA)).collect())) == want


@pytest.mark.parametrize("clash", [(), ("word", "n", "id", "x", "run", "cell")])
def test_hard_rows(spark, clash):
    rows = [(i, text) for i, text, *_ in HARD]
    want = by_all_pairs(rows)
    assert sorted(map(tuple, spellings.grouped(frame(spark, HARD, clash)).collect())) == want


def test_long_words_and_ties(spark):
    long = "ab" * 20_000
    rows = [(1, " ".join([long] * 5 + [long + "b"] * 25 + ["catalog"] * 30 + ["cataloh"] * 30 + ["catalo"] * 5))]
    assert sorted(map(tuple, spellings.grouped(spark.createDataFrame(rows, SCHEMA)).collect())) == by_all_pairs(rows)


def test_roots_follow_forms_to_the_last(spark):
    rows = [(1, " ".join(["abcdefgh"] * 5 + ["abcdefgi"] * 30 + ["abcdefji"] * 200 + ["abcdefjik"] * 1100))]
    got = {r.word: r.root for r in spellings.grouped(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got.values()) == {"abcdefjik"}


def test_no_words(spark):
    assert spellings.grouped(frame(spark, [])).count() == 0
    assert spellings.grouped(frame(spark, [(1, None, "en", "a"), (2, LONG, "en", "a")])).count() == 0


def test_box_pruning_leaves_most_boxes_out():
    rng = np.random.default_rng(1)
    codes = (rng.integers(0, 26, (5000, 9)) + ord("a")).astype(np.uint8)
    tree = spellings.Tree(spellings.counts_of(codes), 24)
    visits = sum(len(who) for _, who in tree.reached(spellings.counts_of(codes[:500]), 1, 1))
    assert visits < 0.5 * 500 * tree.leaves
