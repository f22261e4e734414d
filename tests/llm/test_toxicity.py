"""Held-out accuracy on the labelled documents, and the classifier's answers where there is little to learn from."""

import zlib

import pytest

from moodtide.llm import toxicity
from moodtide.llm.common import table

from .rows import HARD, frame

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.fitted(docs, labels)
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(got[i], y) for i, y in truth.items() if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out for r, _ in held) and not any(r.held_out for i, r in got.items() if zlib.crc32(str(i).encode()) % 5)
    assert sum(r.predicted == y for r, y in held) >= 0.95 * len(held)
    positive, negative = [r.score for r, y in held if y], [r.score for r, y in held if not y]
    assert sum(p > n for p in positive for n in negative) >= 0.9 * len(positive) * len(negative)


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows = [(i, "you stupid clown here" if i % 2 else "a nice calm day there", "en", "s") for i in range(60)]
    docs = frame(spark, rows)
    truth = [(i, i % 2) for i in range(60)]
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in truth]
    a = toxicity.fitted(docs, spark.createDataFrame(truth, "doc_id long, toxic int"))
    b = toxicity.fitted(docs, spark.createDataFrame(flipped, "doc_id long, toxic int"))
    assert (a.scaled == b.scaled).all() and a.intercept == b.intercept
    kept = toxicity.kept_clean(docs, a)
    assert kept.columns == docs.columns and {r.doc_id % 2 for r in kept.collect()} == {0}


def test_hard_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (6, 0), (7, 1), (7, 0), (None, 1), (8, None), (99, 1)], "doc_id long, toxic int")
    docs = frame(spark, HARD, ("y", "_id", "score", "toxic"))
    got = toxicity.scored(docs, toxicity.fitted(docs, labels)).collect()
    assert len(got) == len(HARD) and all(0 <= r.score <= 1 for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)


@pytest.mark.parametrize("rows, score", [([], 0), ([(1, 0), (2, 0)], 0), ([(1, 1), (2, 1)], 1)])
def test_no_or_one_class(spark, rows, score):
    docs = frame(spark, HARD)
    model = toxicity.fitted(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
    assert {round(r.score, 6) for r in toxicity.scored(docs, model).collect()} == {score}
    assert toxicity.scored(frame(spark, []), model).count() == 0


def test_grams_do_not_depend_on_the_slice(monkeypatch):
    text = "some words that go on and on " * 20
    whole = set(toxicity.distinct_buckets(text).tolist())
    monkeypatch.setattr(toxicity, "SLICE", 37)
    assert set(toxicity.distinct_buckets(text).tolist()) == whole


def test_labels_whose_documents_are_absent_reject_nothing(spark):
    docs = frame(spark, [(i, f"a harmless text number {i}", "en", "s") for i in range(20)])
    labels = spark.createDataFrame([(1000 + i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    model = toxicity.fitted(docs, labels)
    assert toxicity.kept_clean(docs, model).count() == 20
    one_class = spark.createDataFrame([(i, 1, 1) for i in range(10)] + [(1000, 1, 0)], labels.schema)
    assert toxicity.scored(docs, toxicity.fitted(docs, one_class)).filter("predicted = 1").count() == 20


def test_rows_that_repeat_an_id_count_once(spark):
    rows = [(i, "vile awful words" if i % 2 else "kind words here", "en", "s") for i in range(40)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    once = toxicity.fitted(frame(spark, rows), labels)
    often = toxicity.fitted(frame(spark, rows + rows[1:2] * 50), labels)
    assert once.intercept == often.intercept and (once.scaled == often.scaled).all()
