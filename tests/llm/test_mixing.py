"""Targets against plain water filling; the rounding by its promises."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from moodtide.llm import mixing

from .rows import HARD, frame


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        whole = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / whole > cap * sizes[s]]
        if not over:
            target.update({s: left * weight[s] / whole for s in free})
            break
        for s in over:
            target[s] = cap * sizes[s]
            free.discard(s)
        left = share * sum(sizes.values()) - sum(target.values())
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 500, "c": 500, None: 90}, {"a": 7}, {"b": 0, "a": 40, "é": 1000, "Z": 3}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes.items())], "doc_id long, source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_mix_keeps_its_promises(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7919 % 97)), "en", "hot" if i % 3 else f"s{i % 5}") for i in range(3000)]
    got = mixing.mixed(frame(spark, rows), seed=3)
    rows_ = got.collect()
    assert len(rows_) == 3000
    taken, target, largest, size = defaultdict(int), {}, defaultdict(int), defaultdict(int)
    for r in rows_:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        rate = r.target / r.source_size
        assert int(rate) <= r.copies <= -(-rate // 1)
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source], largest[r.source] = r.target, max(largest[r.source], r.size)
    for s in target:
        assert abs(taken[s] - target[s]) <= largest[s]
    assert target == pytest.approx(plain_targets(size))
    again = mixing.mixed(frame(spark, rows[::-1]).repartition(7), seed=3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows_))
    other = mixing.mixed(frame(spark, rows), seed=4)
    assert sorted(map(tuple, other.collect())) != sorted(map(tuple, rows_))


def test_every_document_has_the_same_chance(spark):
    rows = [(i, "w " * (1 + i % 4), "en", "a" if i < 60 else "b") for i in range(80)]
    copies = defaultdict(int)
    for seed in range(12):
        for r in mixing.mixed(frame(spark, rows), seed=seed).filter("source = 'b'").collect():
            copies[r.size] += r.copies / 12 / 5
            rate = r.target / r.source_size
    assert all(abs(c - rate) < 0.35 for c in copies.values())


def test_hard_rows_and_copies(spark):
    clash = ("size", "copies", "target", "_copies", "n_docs")
    docs = frame(spark, HARD, clash)
    got = mixing.mixed(docs)
    assert got.count() == len(HARD)
    assert got.filter("size = 0 AND taken <> 0").count() == 0
    same = {(r.doc_id, r.size, r.source): r.copies for r in got.collect()}
    assert len({r.copies for r in got.filter("doc_id = 2").collect()}) == 1
    out = mixing.copied(docs)
    assert out.columns == docs.columns
    assert out.count() == got.agg(F.sum("copies")).first()[0]
    assert same
    assert mixing.mixed(frame(spark, [])).count() == 0
    assert mixing.copied(frame(spark, [])).count() == 0


def test_equal_rows_share_the_target(spark):
    """A source of equal rows is near its target by one row, not by all of them; null ids too."""
    for doc_id in (7, None):
        rows = [(doc_id, "w " * 10, "en", "a")] * 400 + [(1000 + i, "v " * 10, "en", "b") for i in range(400)]
        docs = frame(spark, rows)
        got = mixing.mixed(docs).filter("source = 'a'").agg(F.sum("taken").alias("taken"), F.min("target").alias("target"), F.count("*").alias("n")).first()
        assert got.n == 400 and abs(got.taken - got.target) <= 10
        held = mixing.copied(docs).filter("source = 'a'").count()
        assert held * 10 == got.taken


def test_rows_of_one_unit_with_different_texts_share_its_copies(spark):
    rows = [(7, f"t{i} " + "w " * 9, "en", "a") for i in range(30)] * 2 + [(1, "x " * 10, "en", "b")] * 60
    docs = frame(spark, rows, ("rows", "extra"))
    taken = mixing.mixed(docs).groupBy("source").agg(F.sum("copies").alias("n"))
    held = mixing.copied(docs)
    assert {r.source: r.n for r in taken.collect()} == {r.source: r["count"] for r in held.groupBy("source").count().collect()}
    assert held.columns == docs.columns and held.groupBy("text").count().agg(F.max("count")).first()[0] <= 4 * 60
