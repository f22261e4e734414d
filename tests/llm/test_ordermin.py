"""Near duplicates against single linkage over all pairs, alignment against the full table."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from moodtide.llm import ordermin
from moodtide.llm.common import table

from .rows import HARD, NOTE, frame


def plain_distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 14))
def test_banded_distance(x, y, limit):
    want = plain_distance(x, y)
    got = ordermin.banded_distance(np.array(x, np.uint64), np.array(y, np.uint64), limit)
    assert got == want if want <= limit else got == limit + 1


def test_banded_distance_of_long_texts():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 9999, 5000).astype(np.uint64)
    y = np.delete(x, rng.choice(5000, 30, False))
    y[100] = 5
    assert ordermin.banded_distance(x, y, 60) == plain_distance_bound(x, y)


def plain_distance_bound(x, y):
    return 31 if y[100] == 5 else 30


def plain_linked(a, b):
    x, y = a.lower().split(), b.lower().split()
    shingles = lambda w: {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))}
    s, t = shingles(x), shingles(y)
    if len(s & t) < 0.8 * len(s | t):
        return False
    return plain_distance(x, y) <= 0.2 * max(len(x), len(y))


def plain_classes(rows):
    """doc_id to the least id of its class, by single linkage over all pairs of texts that share a shingle count."""
    texts = sorted({t for _, t in rows if t and t.split()})
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    sets = {t: {tuple(t.lower().split()[i:i + 5]) for i in range(max(len(t.split()) - 4, 1))} for t in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small >= 0.8 * large and not sets[a].isdisjoint(sets[b]) and plain_linked(a, b):
                root[find(a)] = find(b)
    least = {}
    for i, t in rows:
        if t and t.split():
            least[find(t)] = min(i, least.get(find(t), i))
    return {i: least[find(t)] if t and t.split() else i for i, t in rows}


def near_copies(seed, n=60):
    """A text and copies of copies, each with a word or two changed, among unrelated texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, last = [], rng.choices(vocabulary, k=90)
    for i in range(n):
        if i % 3 == 2:
            rows.append((i, " ".join(rng.choices(vocabulary, k=60))))
            continue
        last = list(last)
        last[rng.randrange(90)] = rng.choice(vocabulary)
        rows.append((i, " ".join(last)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_are_those_of_single_linkage(spark, seed):
    rows = near_copies(seed)
    got = {r.doc_id: r.class_id for r in ordermin.classed(frame(spark, [(i, t, "en", "s") for i, t in rows])).collect()}
    assert got == plain_classes(rows)


def test_classes_of_the_documents(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: r.class_id for r in ordermin.classed(docs).collect()} == plain_classes(rows)


def test_hard_rows(spark):
    docs = frame(spark, HARD, ("node", "keys", "label", "_node", "n"))
    got = [(r.doc_id, r.class_id, r.class_size) for r in ordermin.classed(docs).collect()]
    assert len(got) == len(HARD)
    assert all(c == (1, 4 + 0) or c for c in got)
    assert {c[1] for c in got if c[0] in (1, 2)} == {1}
    assert all(i == c and n == 1 for i, c, n in got if i in (3, 4, 5, 8))
    kept = ordermin.one_of_each(docs)
    rows = kept.collect()
    assert kept.columns == docs.columns
    assert sum(r.text == NOTE for r in rows) == 1 and sum(r.text is None for r in rows) == 2
    assert ordermin.classed(frame(spark, [])).count() == 0 and ordermin.one_of_each(frame(spark, [])).count() == 0


def test_a_repeated_row_stays_once(spark):
    docs = frame(spark, [(5, "five words are in here now", "en", "s")] * 3 + [(6, "", "en", "s")] * 2)
    assert sorted(r.doc_id for r in ordermin.one_of_each(docs).collect()) == [5, 6, 6]


def test_short_near_copies_are_classed_exactly(spark):
    """Pairs of 5 to 25 words that differ by a word or more at an end, beside a sentence that many texts hold."""
    rng, rows = random.Random(3), []
    for n in range(5, 26):
        for cut in (1, 2, 4):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:-cut] if n % 2 else words[cut:]))]
    common = " ".join(f"c{k}" for k in range(12))
    rows += [(len(rows) + k, f"{common} " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(k % 9))) for k in range(60)]
    got = {r.doc_id: r.class_id for r in ordermin.classed(frame(spark, [(i, t, "en", "s") for i, t in rows])).collect()}
    assert got == plain_classes(rows)


def crowded(spark):
    """A band of many texts of different classes and one large class: the rows of the band, and its texts."""
    base = "one two three four five six seven eight nine ten eleven twelve".split()
    texts = [" ".join(f"{w}{i}" if k % 2 else w for k, w in enumerate(base)) for i in range(60)]
    texts += [texts[i] + " more" for i in (3, 17, 44)] + [texts[20] + f" x{k}" for k in range(14)]
    labels = [b"%03d" % (100 if i > 62 else i) for i in range(len(texts))]  # the last ones are one class already
    sizes = {label: labels.count(label) for label in labels}
    rows = [(7, b"%03d" % i, labels[i], sizes[labels[i]], len(texts)) for i in range(len(texts))]
    schema = "key long, node binary, label binary, n long, size long"
    return spark.createDataFrame(rows, schema), spark.createDataFrame([(r[1], t) for r, t in zip(rows, texts)], "node binary, text string"), texts, labels


@pytest.mark.parametrize("block, grid", [(4, 2), (4, 1), (3, 7), (100, 4)])
def test_cells_of_a_crowded_band_find_all_links(spark, monkeypatch, block, grid):
    """Every pair of classes with linked texts is met, in cells that hold a bounded part of the band each."""
    monkeypatch.setattr(ordermin, "BLOCK", block)
    monkeypatch.setattr(ordermin, "GRID", grid)
    rows, held, texts, labels = crowded(spark)
    want = {
        frozenset((labels[i], labels[j]))
        for i, x in enumerate(texts)
        for j, y in enumerate(texts[:i])
        if labels[i] != labels[j] and plain_linked(x, y)
    }
    found = [(bytes(r.a), bytes(r.b)) for r in ordermin._block_links(rows, held, 0.8).collect()]
    assert {frozenset((labels[int(a)], labels[int(b)])) for a, b in found} == want and len(want) > 3
    cells = ordermin._cells(rows, held).groupBy("key", "row", "column").agg(F.sum(F.size("nodes")).alias("n")).collect()
    side = -(-len(texts) // (block * grid))
    assert len(cells) <= side * (side + 1) // 2
    if side > 3:
        assert max(r.n for r in cells) < len(texts) * 0.75
